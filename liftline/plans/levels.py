"""Level shifts of a series, and the trend and season inside the levels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workers
from ..operators.levels import level_mad_outliers, mann_kendall, window_medians, winsorize_outliers
from ..params import SLOT_GATE, SLOTS, keys_of

workers.ship()

# --- fixed values ---
MIN_SEGMENT = 0.05
MEDIAN_RATIO = 1.5
MEAN_RATIO = 1.5
MEAN_POINTS = 4
MIN_LEVEL = 20
LOWESS_SHARE = 2 / 3
LOWESS_ROUNDS = 3
MK_ALPHA = 0.01
MK_TAU = 0.8
SEASON_ROUNDS = 4
# --- end of fixed values ---


def mean_shift_breaks(y: np.ndarray, min_share: float = MIN_SEGMENT) -> list[int]:
    """Ends of all but the last segment of the piecewise-constant fit with least BIC."""
    n = len(y)
    h = max(int(math.floor(n * min_share)), 2)
    if n < 2 * h:
        return []
    c1, c2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    size = j - i
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (c2[j] - c2[i]) - (c1[j] - c1[i]) ** 2 / size
    cost = np.where(size >= h, np.maximum(cost, 0.0), np.inf)
    best, back = cost[0].copy(), []
    floor = np.finfo(float).tiny

    def bic(rss: float, breaks: int) -> float:
        fit = n * (math.log(max(rss, floor)) + 1 - math.log(n) + math.log(2 * math.pi))
        return fit + math.log(n) * 2 * (breaks + 1)

    scores = [bic(best[n], 0)]
    for _ in range(max(math.ceil(n / h) - 2, 0)):
        total = best[:, None] + cost
        back.append(np.argmin(total, axis=0))
        best = np.min(total, axis=0)
        if not np.isfinite(best[n]):
            back.pop()
            break
        scores.append(bic(best[n], len(back)))
    m = int(np.argmin(scores))
    out, end = [], n
    for step in range(m - 1, -1, -1):
        end = int(back[step][end])
        out.append(end)
    return sorted(out)


def lasting_shifts(y: np.ndarray, breaks: list[int]) -> list[int]:
    """Breaks that stand: not a season apart, and with clearly different levels around them."""
    edges = {0, len(y), *breaks}
    t = [b for b in breaks if b - SLOTS not in edges and b + SLOTS not in edges]

    def differ(a: float, b: float, ratio: float) -> bool:
        a, b = a or 1e-7, b or 1e-7
        return abs(a / b) > ratio or abs(b / a) > ratio

    # a break that does not stand joins its two segments before the next is judged
    kept, left = [], 0
    for at, b in enumerate(t):
        right = t[at + 1] if at + 1 < len(t) else len(y)
        if differ(float(np.median(y[left:b])), float(np.median(y[b:right])), MEDIAN_RATIO):
            kept.append(b)
            left = b
    near = [b for b in kept if differ(
        float(np.mean(y[max(b - 1 - MEAN_POINTS, 0):b - 1])),
        float(np.mean(y[b:b + MEAN_POINTS])), MEAN_RATIO)]
    long_enough = [b for prev, b in zip([0, *near], near) if b - prev >= MIN_LEVEL]
    return [b for b in long_enough if len(y) - b >= MIN_LEVEL]


def level_shifts(rows: DataFrame, value: str = "modelled_qty") -> DataFrame:
    """Break positions per series, (keys, breaks): last week index of each level but the last.

    Positions count from the series' first week. Levels are sought from the first
    non-zero value on; the weeks before it are no level of their own and no part of one.
    """
    keys = keys_of(rows.columns)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("breaks", T.ArrayType(T.IntegerType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")[value].to_numpy(float)
        sold = np.flatnonzero(y)
        skip = int(sold[0]) if len(sold) else 0
        y = y[skip:]
        found = lasting_shifts(y, mean_shift_breaks(y))
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"breaks": [[b + skip for b in found]]})

    return rows.select(*keys, "t", value).groupBy(*keys).applyInPandas(solve, schema)


def with_levels(rows: DataFrame, breaks: DataFrame, value: str = "modelled_qty") -> DataFrame:
    """Add `level`: 1, 2, ... by the breaks of the row's series (one row per series), 0 before its first sale."""
    t, keys = F.col("t"), keys_of(rows.columns)
    first = F.min(F.when(F.col(value) != 0, t)).over(Window.partitionBy(*keys))
    level = F.size(F.filter("breaks", lambda b: b < t)) + 1
    staged = rows.withColumn("first_t", first).join(breaks, keys)
    return staged.withColumn("level", F.when(t < F.col("first_t"), 0).otherwise(level).cast("int")).drop("breaks", "first_t")


def trendless_levels(rows: DataFrame, breaks: DataFrame, value: str = "modelled_qty",
                     alpha: float = MK_ALPHA, tau: float = MK_TAU) -> DataFrame:
    """Breaks without those whose shift is only the trend of the following level."""
    leveled = with_levels(rows, breaks, value)
    keys = keys_of(rows.columns)
    w = Window.partitionBy(*keys).orderBy("level")
    medians = leveled.groupBy(*keys, "level").agg(
        F.median(value).alias("mid"), (F.min("t") - 1).alias("at"))
    medians = medians.withColumn("before", F.lag("mid").over(w))
    tested = medians.join(mann_kendall(leveled, value).select(*keys, "level", "tau", "p_value"),
                          [*keys, "level"])
    flat = F.coalesce(F.col("p_value"), F.lit(1.0)) > alpha
    up, down = F.col("mid") > F.col("before"), F.col("mid") < F.col("before")
    stands = (up & ((F.col("tau") < -tau) | flat)) | (down & ((F.col("tau") < tau) | flat))
    kept = (tested.filter(F.col("level") > 1).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.when(stands, F.col("at").cast("int")))).alias("kept")))
    return (breaks.join(kept, keys, "left")
            .select(*keys, F.coalesce("kept", F.expr("cast(array() as array<int>)")).alias("breaks")))


def lowess(y: np.ndarray, share: float = LOWESS_SHARE, rounds: int = LOWESS_ROUNDS) -> np.ndarray:
    """Locally weighted line with tricube weights and bisquare robustness rounds."""
    n = len(y)
    if n < 3:
        return y.astype(float)
    x = np.arange(n, dtype=float)
    k = max(min(int(share * n + 1e-10), n), 2)
    distance = np.abs(x[:, None] - x[None, :])
    reach = np.sort(distance, axis=1)[:, k - 1]
    near = np.clip(distance / np.maximum(reach, 1e-12)[:, None], 0.0, 1.0)
    kernel = (1 - near ** 3) ** 3
    robust, fit = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        w = kernel * robust[None, :]
        sw = np.maximum(w.sum(axis=1), 1e-300)
        mx, my = (w @ x) / sw, (w @ y) / sw
        dx = x[None, :] - mx[:, None]
        sxx = (w * dx * dx).sum(axis=1)
        sxy = (w * dx * y[None, :]).sum(axis=1)
        slope = np.where(sxx > 1e-9, sxy / np.maximum(sxx, 1e-300), 0.0)
        fit = my + slope * (x - mx)
        residual = y - fit
        cut = 6 * np.median(np.abs(residual))
        if cut < 1e-12 * max(np.abs(y).max(), 1.0):
            break
        u = np.clip(np.abs(residual) / cut, 0.0, 1.0)
        robust = (1 - u ** 2) ** 2
    return fit


def _calm(rows: DataFrame, breaks: DataFrame, value: str) -> DataFrame:
    """Keys, t, level, value and `calm`: the series with its outliers set to their level's bounds."""
    staged = window_medians(with_levels(rows, breaks, value), value)
    staged = staged.withColumn("deviation", F.col(value) - F.col("window_median"))
    staged = winsorize_outliers(level_mad_outliers(staged, "deviation"), "deviation")
    return staged.select(*keys_of(rows.columns), "level", "t", value,
                         (F.col("winsorized") + F.col("window_median")).alias("calm"))


def level_trend(rows: DataFrame, breaks: DataFrame, value: str = "modelled_qty") -> DataFrame:
    """Smooth trend per level on the series without outliers; adds `level`, `level_trend`.

    Before the first sale the trend is 0, and these weeks bear on no other.
    """
    calm = _calm(rows, breaks, value)
    schema = T.StructType(calm.schema.fields + [T.StructField("level_trend", T.DoubleType())])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["calm"].to_numpy(float)
        return pdf.assign(level_trend=lowess(y) if pdf["level"].iloc[0] else np.zeros(len(y)))

    return calm.groupBy(*keys_of(calm.columns), "level").applyInPandas(smooth, schema)


def trend_and_season(y: np.ndarray, calm: np.ndarray, level: np.ndarray, t: np.ndarray,
                     rounds: int = SEASON_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Trend per level and centred season, fitted in turns; both 0 where level is 0, the weeks before the first sale.

    A series with too few weeks for seasonality has no season.
    """
    sold = level > 0
    trend, season = np.zeros(len(y)), np.zeros(len(y))
    slot = (t - 1) % SLOTS
    for turn in range(rounds if sold.sum() >= SLOT_GATE else 1):
        for one in np.unique(level[sold]):
            trend[level == one] = lowess(calm[level == one] - season[level == one])
        if sold.sum() < SLOT_GATE:
            break
        sums = np.bincount(slot[sold], (y - trend)[sold], SLOTS)
        means = sums / np.maximum(np.bincount(slot[sold], minlength=SLOTS), 1)
        season = np.where(sold, means[slot] - means[slot[sold]].mean(), 0.0)
    return trend, season


def level_decompose(rows: DataFrame, breaks: DataFrame, value: str = "modelled_qty",
                    rounds: int = SEASON_ROUNDS) -> DataFrame:
    """Level trend and season fitted in turns: adds `level`, `level_trend`, `seasonal`, `remainder`, which sum up to the value.

    The trend is smoothed on the values without season, the season is the mean by
    place in the 52 weeks of the values without trend. Weeks before the first sale
    have neither and bear on neither.
    """
    calm = _calm(rows, breaks, value)
    added = [T.StructField(c, T.DoubleType()) for c in ("level_trend", "seasonal", "remainder")]
    schema = T.StructType(calm.schema.fields + added)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf[value].to_numpy(float)
        trend, season = trend_and_season(y, pdf["calm"].to_numpy(float), pdf["level"].to_numpy(), pdf["t"].to_numpy(), rounds)
        return pdf.assign(level_trend=trend, seasonal=season, remainder=y - trend - season)

    # a series has at most one row per calendar week
    return calm.groupBy(*keys_of(calm.columns)).applyInPandas(fit, schema).drop("calm")


def seasonal_decompose(rows: DataFrame, value: str, trend: str) -> DataFrame:
    """Add `seasonal` (centred mean by position in the 52-week cycle) and `remainder`."""
    keys = keys_of(rows.columns)
    g = Window.partitionBy(*keys)
    slot = Window.partitionBy(*keys, F.pmod(F.col("t") - 1, F.lit(SLOTS)))
    above = F.col(value) - F.col(trend)
    staged = rows.withColumn("raw_season", F.avg(above).over(slot))
    staged = staged.withColumn("seasonal", F.col("raw_season") - F.avg("raw_season").over(g))
    return staged.withColumn(
        "remainder", F.col(value) - F.col(trend) - F.col("seasonal")).drop("raw_season")
