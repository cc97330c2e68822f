"""Panel features: gaps, prices, lags, slots, cross-group promos."""

import random

from pyspark.sql import functions as F

from liftline.operators import clean as K
from liftline.operators import features as X
from liftline.operators import selection as G
from liftline.params import LAG_COLUMNS


def test_densify(group_rows, weeks):
    panel = group_rows([dict(group_code="A", yr_wk=2, qty=5.0), dict(group_code="B", yr_wk=3, qty=7.0)])
    rows = K.zero_fill(X.densify(panel, weeks(3)).select("group_code", "yr_wk", "dept", "qty"))
    got = {(r["group_code"], r["yr_wk"]): r["qty"] for r in rows.collect()}
    assert got == {("A", 1): 0, ("A", 2): 5, ("A", 3): 0, ("B", 1): 0, ("B", 2): 0, ("B", 3): 7}
    assert {r["dept"] for r in rows.collect()} == {1}


def test_densify_ignores_weeks_outside_the_calendar(group_rows, weeks):
    panel = group_rows([dict(yr_wk=w, qty=1.0) for w in (1, 2, 9)])
    assert [r["yr_wk"] for r in X.densify(panel, weeks(4)).orderBy("yr_wk").collect()] == [1, 2, 3, 4]


def test_price_fill_average_counts_the_zeros(group_rows):
    panel = group_rows([dict(yr_wk=w, regular_price=p) for w, p in enumerate([8.0, 10.0, 0.0, 12.0], 1)])
    got = [r["regular_price"] for r in X.fill_price_avg(panel).orderBy("yr_wk").collect()]
    assert got == [8.0, 10.0, 6.0, 12.0]


def commonest(near):
    near = [p for p in near if p]
    return min(set(near), key=lambda p: (-near.count(p), p)) if near else 0.0


def test_price_fill_mode(group_rows):
    rng = random.Random(3)
    prices = [rng.choice([0.0, 0.0, 0.0, 5.0, 6.0, 7.0]) for _ in range(80)]
    prices[20:40] = [0.0] * 20
    panel = group_rows([dict(yr_wk=w, live_price=p) for w, p in enumerate(prices, 1)])
    plain, chained = [], list(prices)
    for i, p in enumerate(prices):
        plain.append(p or commonest(prices[max(i - 4, 0):i + 5]))
        chained[i] = p or commonest(chained[max(i - 4, 0):i + 5])
    for recursive, want in ((False, plain), (True, chained)):
        rows = X.fill_price_mode(panel, ("live_price",), recursive).orderBy("yr_wk").collect()
        assert [r["live_price"] for r in rows] == want


def test_lags_and_head(group_rows):
    panel = group_rows([dict(yr_wk=w, cpp_flag=f) for w, f in enumerate([1, 0, 0, 0, 0, 1], 1)])
    rows = X.drop_head(X.promo_lags(K.one_hot_page(panel))).orderBy("yr_wk").collect()
    assert [r["yr_wk"] for r in rows] == [5, 6]
    assert [rows[0][f"cpp_flag_lag_{k}"] for k in (1, 2, 3, 4)] == [0, 0, 0, 1]


def test_slot_gate(group_rows):
    few = X.week_slot(group_rows([dict(yr_wk=w) for w in range(1, 104)]))
    assert few.filter("slot IS NOT NULL").count() == 0
    many = X.week_slot(group_rows([dict(yr_wk=w) for w in range(1, 106)])).orderBy("yr_wk").collect()
    assert [r["slot"] for r in many] == [*range(1, 53), *range(1, 53), 1]


def test_keep_lags_exactly(spark, group_rows):
    panel = X.promo_lags(K.one_hot_page(group_rows([dict(yr_wk=w) for w in range(1, 7)])))
    allowed = spark.createDataFrame([("G", 1, "'cpp_flag_lag_1', 'pa_depth_lag_2'")],
                                    "focus_group string, focus_dept int, promos string")
    kept = X.keep_lags(X.lags_long(panel), allowed)
    assert {r["lag"] for r in kept.collect()} == {"cpp_flag_lag_1", "pa_depth_lag_2"}
    other = allowed.withColumn("focus_group", F.lit("other"))
    assert X.keep_lags(X.lags_long(panel), other).select("lag").distinct().count() == len(LAG_COLUMNS)


def test_cross_features(spark, group_rows):
    panel = K.one_hot_page(group_rows(
        [dict(group_code="A", yr_wk=w, cpp_flag=w % 2) for w in (1, 2)] + [dict(group_code="B", yr_wk=1)]
        + [dict(group_code="C", dept=d, yr_wk=d) for d in (1, 2)]))
    edges = spark.createDataFrame(
        [("A", "B", "'cpp_flag', 'unknown'"), ("C", "B", "'cpp_flag'"), ("A", "gone", "'cpp_flag'")],
        "focus_group string, target_group string, promos string")
    cann = X.cross_features(panel, edges, "cann")
    assert {(r["target_group"], r["yr_wk"], r["feature"], r["value"]) for r in cann.collect()} == {
        ("B", 1, "A_cpp_flag_CANN_PROMO", 1.0), ("B", 2, "A_cpp_flag_CANN_PROMO", 0.0),
        ("B", 1, "C_cpp_flag_CANN_PROMO", 0.0), ("B", 2, "C_cpp_flag_CANN_PROMO", 0.0)}
    # C occurs in two departments, which bars it from halo features
    assert {r["focus_group"] for r in X.cross_features(panel, edges, "halo").collect()} == {"A"}


def test_doubled_edges_give_each_feature_once(spark, group_rows):
    panel = K.one_hot_page(group_rows([dict(group_code="A", yr_wk=w, cpp_flag=w % 2) for w in (1, 2)] + [dict(group_code="B", yr_wk=1)]))
    edges = spark.createDataFrame(
        [("A", "B", "'cpp_flag', 'cpp_flag'"), ("A", "B", "'cpp_flag'"), ("A", "B", None)],
        "focus_group string, target_group string, promos string")
    assert sorted((r["yr_wk"], r["value"]) for r in X.cross_features(panel, edges, "cann").collect()) == [(1, 1.0), (2, 0.0)]


def test_crowded_focus_group_is_split_without_loss(spark, group_rows):
    panel = K.one_hot_page(group_rows(
        [dict(group_code="A", yr_wk=w, cpp_flag=w % 2) for w in (1, 2, 3)]
        + [dict(group_code=f"T{i}") for i in range(40)]))
    edges = spark.createDataFrame([("A", f"T{i}", "'cpp_flag'") for i in range(40)],
                                  "focus_group string, target_group string, promos string")
    whole = X.cross_features(panel, edges, "cann")
    split = X.cross_features(panel, edges, "cann", edges_per_task=3)
    assert sorted(whole.collect()) == sorted(split.collect()) and split.count() == 120


def test_page_columns(group_rows):
    rows = group_rows([dict(page_location=p, yr_wk=w) for w, p in enumerate(["FRONT", "BACK", None], 1)])
    once = K.one_hot_page(rows)
    assert [(r["page_front"], r["page_back"], r["page_inside"]) for r in once.orderBy("yr_wk").collect()] == [
        (1, 0, 0), (0, 1, 0), (0, 0, 0)]
    assert K.one_hot_page(once).collect() == once.collect()
    bare = K.one_hot_page(rows.drop("page_location"))
    assert bare.filter("page_front + page_back + page_inside > 0").count() == 0


def test_selection(spark):
    panel = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "dept int, group_code string")
    chosen = panel.filter("group_code = 'A'")
    got = G.interest_or_sample(chosen, panel)
    assert {tuple(r) for r in got.collect()} == {(1, "A"), (2, "C")}
    other = spark.createDataFrame([("x", 5)], "group_code string, extra int")
    assert [tuple(r) for r in G.union_frames(panel.limit(0), other).collect()] == [(None, "x")]
