"""Level shifts, outliers, trend inside levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftline.operators import levels as L
from liftline.plans import levels as LV


def brute_breaks(y, h, m):
    """Least squared error over all placements of m breaks."""
    from itertools import combinations
    best = (np.inf, [])
    for cut in combinations(range(h, len(y) - h + 1), m):
        edges = [0, *cut, len(y)]
        if min(np.diff(edges)) < h:
            continue
        cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:]))
        best = min(best, (cost, list(cut)))
    return best


def test_breaks_match_exhaustive_search():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(10, 1, 14), rng.normal(30, 1, 12), rng.normal(5, 1, 14)])
    found = LV.mean_shift_breaks(y, 0.1)
    assert found == brute_breaks(y, 4, len(found))[1]
    assert {14, 26} <= set(found)


def test_shift_filters():
    y = np.array([10.0] * 60 + [30.0] * 60 + [32.0] * 40)
    assert LV.lasting_shifts(y, [60, 120]) == [60]
    # a pair of breaks one season apart is seasonal
    assert LV.lasting_shifts(np.array([10.0] * 60 + [30.0] * 52 + [10.0] * 60), [60, 112]) == []
    # levels that are too short
    assert LV.lasting_shifts(np.array([10.0] * 60 + [30.0] * 10), [60]) == []


def test_lowess_reproduces_a_line():
    y = 3 + 0.5 * np.arange(60)
    np.testing.assert_allclose(LV.lowess(y), y, atol=1e-8)
    y[30] += 50
    assert abs(LV.lowess(y)[30] - 18) < 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(8, 13, 60), rng.integers(28, 34, 70)]).astype(float)
    return spark.createDataFrame(
        [("G", i + 1, float(v)) for i, v in enumerate(values)], "group_code string, t int, modelled_qty double")


def test_level_shifts_and_trend(rows):
    breaks = LV.level_shifts(rows)
    assert breaks.first()["breaks"] == [60]
    out = LV.level_trend(rows, breaks).orderBy("t").toPandas()
    assert out["level"].tolist() == [1] * 60 + [2] * 70
    assert out["level_trend"][:60].between(7, 14).all() and out["level_trend"][60:].between(27, 35).all()
    parts = LV.seasonal_decompose(
        rows.withColumn("trend", F.lit(20.0)), "modelled_qty", "trend").toPandas()
    assert parts["seasonal"].sum() == pytest.approx(0, abs=1e-8)
    np.testing.assert_allclose(parts["seasonal"] + parts["remainder"] + 20.0, parts["modelled_qty"])


def test_weeks_before_the_first_sale_are_no_level(spark, rows):
    late = rows.withColumn("t", (F.col("t") + 30).cast("int")).unionByName(
        spark.range(1, 31).selectExpr("'G' AS group_code", "cast(id AS int) AS t", "0.0D AS modelled_qty"))
    breaks = LV.level_shifts(late)
    assert breaks.first()["breaks"] == [90]
    levels = LV.with_levels(late, breaks).orderBy("t").toPandas()["level"].tolist()
    assert levels == [0] * 30 + [1] * 60 + [2] * 70


def test_trend_and_season_start_with_the_first_sale(spark):
    rng = np.random.default_rng(4)
    season = 3 * np.sin(2 * np.pi * np.arange(52) / 52)
    sold = 11 + rng.uniform(-1, 1, 208)
    plain = spark.createDataFrame([(1, "G", i + 1, float(v)) for i, v in enumerate([0.0] * 60 + sold.tolist())],
                                  "dept int, group_code string, t int, modelled_qty double")
    breaks = LV.level_shifts(plain)
    for frame in (LV.level_trend(plain, breaks), LV.level_decompose(plain, breaks)):
        out = frame.orderBy("t").toPandas()
        assert (out["level_trend"][:60] == 0).all() and out["level_trend"][60:].between(10.5, 11.5).all()
    values = [0.0] * 60 + [float(v + season[(i + 60) % 52]) for i, v in enumerate(sold)]
    seasonal = spark.createDataFrame([(d, "G", i + 1, v * d) for d in (1, 2) for i, v in enumerate(values)],
                                     "dept int, group_code string, t int, modelled_qty double")
    out = LV.level_decompose(seasonal, LV.level_shifts(seasonal)).orderBy("dept", "t").toPandas()
    for d, part in out.groupby("dept"):
        part = part.reset_index(drop=True)
        np.testing.assert_allclose(part["level_trend"] + part["seasonal"] + part["remainder"], part["modelled_qty"])
        assert (part[["level_trend", "seasonal", "remainder"]][:60] == 0).all().all()
        # outlying weeks are pulled in before smoothing, so the trend keeps a little of the season
        assert part["level_trend"][60:].between(10 * d, 12 * d).all()
        assert np.abs(part["seasonal"][60:].to_numpy() - d * season[(np.arange(60, 268)) % 52]).max() < 1.2 * d


def test_mann_kendall(rows):
    leveled = LV.with_levels(rows, LV.level_shifts(rows))
    got = {r["level"]: r for r in L.mann_kendall(leveled, "modelled_qty").collect()}
    for level, part in leveled.toPandas().sort_values("t").groupby("level"):
        y = part["modelled_qty"].to_numpy()
        n = len(y)
        s = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
        ties = np.unique(y, return_counts=True)[1]
        pairs = n * (n - 1) / 2
        tau = s / np.sqrt(pairs * (pairs - (ties * (ties - 1) / 2).sum()))
        assert (got[level]["s"], got[level]["tau"]) == (s, pytest.approx(tau))
        from math import erfc, sqrt
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        assert got[level]["p_value"] == pytest.approx(erfc(abs(s - np.sign(s)) / sqrt(var) / sqrt(2)), abs=1e-6)
    assert LV.trendless_levels(rows, LV.level_shifts(rows)).first()["breaks"] == [60]


def test_periodic_pairs(spark):
    marked = spark.createDataFrame(
        [("G", t, t in (3, 55, 60)) for t in range(1, 113)], "group_code string, t int, hit boolean")
    got = L.periodic_pairs(marked, "hit").filter("paired").select("t").collect()
    assert sorted(r["t"] for r in got) == [3, 55]
