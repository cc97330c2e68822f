"""Operators on the levels of a series.

Rows carry the keys of a series, level, t (1, 2, ... in the series) and a value. A level is
part of one series, so its length is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal_two_sided_p, ratio_or_null
from ..params import SLOTS, keys_of

# --- fixed values ---
WINDOW_WEEKS = 14
OUTLIER_SCALE = 1.4
WINSOR_SCALE = 1.3
OUTLIER_BOUND = 0.1
# --- end of fixed values ---


def by_level(frame: DataFrame) -> Window:
    return Window.partitionBy(*keys_of(frame.columns), "level")


def window_medians(rows: DataFrame, value: str, length: int = WINDOW_WEEKS) -> DataFrame:
    """Add `window_median`: median over consecutive runs of `length` rows of the level."""
    rn = F.row_number().over(by_level(rows).orderBy("t"))
    staged = rows.withColumn("run", F.floor((rn - 1) / length).cast("int"))
    per_run = Window.partitionBy(*keys_of(rows.columns), "level", "run")
    return staged.withColumn("window_median", F.median(value).over(per_run)).drop("run")


def level_center(rows: DataFrame, value: str) -> DataFrame:
    """Add `center` and `mad`: median and median absolute deviation of the level."""
    staged = rows.withColumn("center", F.median(value).over(by_level(rows)))
    return staged.withColumn("mad", F.median(F.abs(F.col(value) - F.col("center"))).over(by_level(rows)))


def level_mad_outliers(rows: DataFrame, value: str, k: float = OUTLIER_BOUND) -> DataFrame:
    """Add `outlier`: farther than k scaled MADs from the level's median."""
    return level_center(rows, value).withColumn(
        "outlier", F.abs(F.col(value) - F.col("center")) > k * OUTLIER_SCALE * F.col("mad"))


def periodic_pairs(rows: DataFrame, mark: str, frequency: int = SLOTS) -> DataFrame:
    """Add `paired`: a marked row with another marked row exactly one season away.

    A range frame finds the partner, so no row is joined to another.
    """
    hit = F.max(F.col(mark).cast("int"))
    w = Window.partitionBy(*keys_of(rows.columns)).orderBy("t")
    partner = F.greatest(*[
        F.coalesce(hit.over(w.rangeBetween(d, d)), F.lit(0)) for d in (-frequency, frequency)])
    return rows.withColumn("paired", F.col(mark) & (partner == 1))


def winsorize_outliers(rows: DataFrame, value: str, k: float = OUTLIER_BOUND) -> DataFrame:
    """Set outliers that do not recur after a season to the level's bound.

    Input columns `center`, `mad`, `outlier`; adds `winsorized`.
    """
    staged = periodic_pairs(rows, "outlier")
    reach = k * WINSOR_SCALE * F.col("mad")
    bound = F.when(F.col(value) > 0, F.col("center") + reach).otherwise(F.col("center") - reach)
    return staged.withColumn(
        "winsorized", F.when(F.col("outlier") & ~F.col("paired"), bound).otherwise(F.col(value)))


def _concordance(values: Column) -> Column:
    """Sum over ordered pairs of sign(later - earlier), inside the row's array."""
    def against_earlier(acc: Column, i: Column) -> Column:
        here = F.element_at(values, i)
        earlier = F.slice(values, 1, i - 1)
        return acc + F.aggregate(earlier, F.lit(0.0), lambda s, v: s + F.signum(here - v))
    later = F.when(F.size(values) > 1, F.sequence(F.lit(2), F.size(values))).otherwise(
        F.expr("cast(array() as array<int>)"))
    return F.aggregate(later, F.lit(0.0), against_earlier)


def mann_kendall(rows: DataFrame, value: str) -> DataFrame:
    """Trend test per level: n, s, tau and two-sided p by normal approximation.

    Ties lower the denominator of tau and the variance of s; p uses the
    continuity correction.
    """
    keys = [*keys_of(rows.columns), "level"]
    # at most one element per calendar week
    series = rows.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))),
        lambda x: x["v"]).alias("values"))
    ties = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(*keys).agg(
        F.sum(F.col("c") * (F.col("c") - 1)).alias("tied_pairs2"),
        F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("tied_var"))
    n = F.col("n").cast("double")
    scored = series.join(ties, keys).select(
        *keys, F.size("values").alias("n"), _concordance(F.col("values")).alias("s"),
        "tied_pairs2", "tied_var")
    pairs = n * (n - 1) / 2
    variance = (n * (n - 1) * (2 * n + 5) - F.col("tied_var")) / 18
    z = ratio_or_null(F.col("s") - F.signum("s"), F.sqrt(variance))
    return scored.select(
        *keys, "n", "s",
        ratio_or_null(F.col("s"), F.sqrt(pairs * (pairs - F.col("tied_pairs2") / 2))).alias("tau"),
        normal_two_sided_p(z).alias("p_value"))
