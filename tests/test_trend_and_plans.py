"""Trend, anomalies, baseline, forecast, insights and pull-forward."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftline.operators import clean as K
from liftline.operators import features as X
from liftline.operators import regression as R
from liftline.operators import trend as T
from liftline.params import PROMOS, PROMOTIONS, AnomalyParams, ModelParams
from liftline.plans import baseline as B
from liftline.plans import forecast as FC
from liftline.plans import insights as I
from liftline.plans import model_table as M
from liftline.plans import pull_forward as P
from liftline.plans import regression as RG


def trend_of(group_rows, qty):
    rows = group_rows([dict(yr_wk=w, qty=float(q)) for w, q in enumerate(qty, 1)])
    out = T.linear_trend(rows.withColumn("modelled_qty", F.col("qty"))).orderBy("yr_wk").collect()
    return [r["trend"] for r in out]


@pytest.mark.parametrize("qty, want", [
    ([0, 0, 10, 12, 14], [0, 0, 10, 12, 14]), ([0, 0, 0], [0, 0, 0]), ([0, 7], [0, 7])])
def test_trend(group_rows, qty, want):
    assert trend_of(group_rows, qty) == pytest.approx(want)


@pytest.mark.parametrize("listed, want", [((5,), 2.0), ((1,), 100.0)])
def test_anomaly(group_rows, listed, want):
    rows = group_rows([dict(yr_wk=w, qty=float(q)) for w, q in enumerate([0, 1, 2, 3, 100], 1)])
    staged = K.one_hot_page(rows).withColumns({
        "modelled_qty": F.col("qty"), "trend": F.lit(0.0), "slot": F.lit(None).cast("int")})
    out = T.repair_anomalies(staged, AnomalyParams(shock_weeks=listed)).orderBy("yr_wk").collect()
    assert out[4]["modelled_qty"] == want


def test_no_calm_week_no_repair(group_rows):
    rows = group_rows([dict(yr_wk=w, qty=float(w), cpp_flag=1) for w in range(1, 9)])
    staged = K.one_hot_page(rows).withColumns({
        "modelled_qty": F.col("qty"), "trend": F.lit(0.0), "slot": F.lit(None).cast("int")})
    assert T.repair_anomalies(staged, AnomalyParams(shock_weeks=tuple(range(1, 9)))).filter("repaired = 1").count() == 0


def history(group_rows, base, **cols):
    rows = group_rows([dict(yr_wk=w, qty=b, **{k: v[w - 1] for k, v in cols.items()}) for w, b in enumerate(base, 1)])
    return rows.withColumns({"baseline_qty": F.col("qty"), "lift_share": F.lit(0.5)})


def test_forecast(group_rows):
    past = history(group_rows, [0.0, 0.0, 10.0, 12.0, 14.0], cpp_flag=[0, 0, 1, 0, 0])
    assert FC.baseline_level(past).first()["level"] == 14.0
    plan = group_rows([dict(yr_wk=9, cpp_flag=1, digest_flag=1)])
    out = FC.forecast(past, plan).first()
    assert out["qty"] == pytest.approx(14 * 1.5 * 1.1)
    assert out["sales"] == pytest.approx(out["qty"] * 10.0)


def test_mean_price_default(group_rows):
    past = history(group_rows, [1.0, 2.0], regular_price=[0.0, 0.0])
    assert FC.mean_price(past).first()["price"] == 10.0


def test_insights(group_rows):
    past = history(group_rows, [5.0, 9.0, 9.0, 0.0, 2.0], cpp_flag=[1, 1, 0, 0, 0], sales=[50.0, 90.0, 10.0, 0.0, 20.0])
    only_past = {(r["insight_type"], r["promo_type"]): r for r in I.insights(past).collect()}
    assert set(only_past) == {("PROMO_EFFECTIVENESS", "cpp_flag"), ("BEST_WEEK", "ALL"), ("WORST_WEEK", "ALL")}
    assert only_past[("BEST_WEEK", "ALL")]["analysis"] == "Best week: 2, 9 units"
    assert only_past[("BEST_WEEK", "ALL")]["recommendation"] == "Plan these promotions again: cpp_flag"
    assert only_past[("WORST_WEEK", "ALL")]["recommendation"] == "Plan without these promotions: No promotions"
    assert only_past[("PROMO_EFFECTIVENESS", "cpp_flag")]["recommendation"] == "Promote more often"
    planned = FC.forecast(past, group_rows([dict(yr_wk=9)]))
    kinds = {r["insight_type"]: r for r in I.insights(past, planned).collect()}
    assert {"FORECAST_TREND", "FORECAST_BEST_WEEK"} <= set(kinds)
    assert kinds["FORECAST_TREND"]["value"] == pytest.approx((5.0 - 5.0) / 5.0, abs=1e-9)


@pytest.fixture(scope="module")
def modelled(group_rows, weeks):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("A", "B"):
        for w in range(1, 131):
            rows.append(dict(
                group_code=g, yr_wk=w, qty=float(rng.integers(20, 80)), sales=float(rng.integers(200, 800)),
                pa_depth=float(rng.choice([0, 0, 5])), cpp_flag=int(rng.integers(0, 2)),
                digital_flag=int(rng.integers(0, 2)), page_location=rng.choice(["FRONT", "BACK", "INSIDE", None])))
    return M.model_table(group_rows(rows), weeks(130)).persist()


def test_model_table_shape(modelled):
    assert modelled.count() == 2 * (130 - 4)
    assert modelled.filter("slot IS NULL").count() == 0


def test_row_order_and_partitions_do_not_matter(group_rows, weeks):
    rows = group_rows([dict(group_code=g, yr_wk=w, qty=float((w * 7) % 11)) for g in "AB" for w in range(1, 30)])
    tables = [M.model_table(r, weeks(30)).orderBy("group_code", "yr_wk").collect()
              for r in (rows, rows.orderBy(F.rand(1)).repartition(9))]
    assert tables[0] == tables[1]


def test_seasonal_residual_is_orthogonal_to_slots(modelled):
    out = T.seasonal_adjust(modelled, "modelled_qty", "left")
    worst = out.groupBy("group_code", "slot").agg(F.abs(F.sum("left")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-8


def dummies(pdf):
    return np.column_stack([(pdf["slot"] == s).to_numpy(float) for s in sorted(pdf["slot"].unique())])


def test_ols_residuals_against_full_design(modelled):
    got = R.ols_residuals(modelled, "modelled_qty", PROMOTIONS, ["dept", "group_code"], "yr_wk", slot="slot").toPandas()
    for g, pdf in modelled.toPandas().groupby("group_code"):
        pdf = pdf.sort_values("yr_wk")
        x = np.column_stack([np.ones(len(pdf)), pdf[list(PROMOTIONS)].to_numpy(float), dummies(pdf)])
        y = pdf["modelled_qty"].to_numpy()
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        np.testing.assert_allclose(got[got.group_code == g].sort_values("yr_wk")["residual"], want, atol=1e-7)


def test_coefficients_recover_a_known_model(modelled):
    staged = modelled.withColumn("y", 3 + 2 * F.col("cpp_flag") - 1.5 * F.col("pa_depth") + F.col("slot") * 0.1)
    rows = R.ols_coefficients(staged, "y", ["cpp_flag", "pa_depth"], ["dept", "group_code"], "yr_wk", slot="slot").collect()
    coef = {(r["group_code"], r["term"]): r["coef"] for r in rows}
    for g in "AB":
        assert coef[(g, "cpp_flag")] == pytest.approx(2) and coef[(g, "pa_depth")] == pytest.approx(-1.5)


def test_pull_forward_against_numpy(modelled):
    got = {(r["group_code"], r["lag"]): r["r"]
           for r in P.lag_correlation(P.promo_residuals(modelled), "residual").collect()}
    checked = 0
    for g, pdf in modelled.toPandas().groupby("group_code"):
        pdf = pdf.sort_values("yr_wk")
        y = np.maximum(pdf["modelled_qty"] - pdf["trend"], 0).to_numpy()
        x = np.column_stack([np.ones(len(pdf)), pdf[list(PROMOTIONS)].to_numpy(float), dummies(pdf)])
        res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        for lag in [c for c in pdf.columns if "_lag_" in c]:
            v = pdf[lag].to_numpy(float)
            assert ((g, lag) in got) == (np.ptp(v) > 0)
            if np.ptp(v) > 0:
                assert got[(g, lag)] == pytest.approx(np.corrcoef(res, v)[0, 1], abs=1e-7)
                checked += 1
    assert checked > 20
    lists = P.pull_forward(modelled).collect()
    for r in lists:
        names = [n.strip("'") for n in r["pf_promotions"].split(", ")]
        assert set(names) == {lag for (g, lag), v in got.items() if g == r["focus_group"] and v <= -1e-6}


def test_regression_outputs(modelled):
    coef = RG.promo_regression(modelled).persist()
    classes = RG.coefficient_classes(coef).toPandas()
    assert len(classes) == 2
    named = [n for c in RG.CLASSES for t in classes[c] for n in t.split(", ") if n]
    assert len(named) == coef.filter(F.col("term").isin(*PROMOTIONS)).count()
    some = RG.lag_contributions(modelled, coef).first()
    assert some["lag"].rsplit("_", 2)[1] == "lag"
    assert RG.wide_coefficients(coef, PROMOTIONS).columns == ["dept", "group_code", *[f"{p}_coef" for p in PROMOTIONS]]


def test_relation_coefficients(spark, modelled):
    edges = spark.createDataFrame([("A", "B", "'cpp_flag', 'digital_flag'")],
                                  "focus_group string, target_group string, promos string")
    features = X.cross_features(modelled, edges, "cann")
    got = {r["promo"]: r["coef"] for r in RG.relation_coefficients(modelled, features).collect()}
    pdf = modelled.toPandas()
    a = pdf[pdf.group_code == "A"].sort_values("yr_wk")
    b = pdf[pdf.group_code == "B"].sort_values("yr_wk")
    x = np.column_stack([np.ones(len(a)), a["cpp_flag"], a["digital_flag"]]).astype(float)
    want = np.linalg.lstsq(x, (b["modelled_qty"] - b["trend"]).to_numpy(), rcond=None)[0]
    assert (got["cpp_flag"], got["digital_flag"]) == pytest.approx((want[1], want[2]))


def test_wide_results(spark, modelled):
    rows = B.baseline_results(modelled)
    coef = RG.promo_regression(modelled).persist()
    wide = RG.model_results(rows, coef)
    assert wide.count() == modelled.count()
    assert len(wide.columns) == 15 + 9 + 52 + 36 + 36 + 1
    lag = coef.filter("term = 'cpp_flag_lag_1' AND group_code = 'A'").first()["coef"]
    for r in wide.filter("group_code = 'A'").join(
            modelled.select("group_code", "yr_wk", "cpp_flag_lag_1"), ["group_code", "yr_wk"]).take(5):
        assert r["cpp_flag_lag_1_contri"] == pytest.approx(lag * r["cpp_flag_lag_1"])
    edges = spark.createDataFrame([("A", "B", 1, "'cpp_flag', 'digital_flag'")],
                                  "focus_group string, target_group string, focus_dept int, promos string")
    one = RG.wide_relation_coefficients(
        RG.relation_coefficients(modelled, X.cross_features(modelled, edges, "cann"))).first()
    assert one["cpp_flag_focus_coef"] is not None and one["pa_depth_focus_coef"] is None


def test_holiday_terms(modelled):
    rows = modelled.withColumn("new_years", (F.col("slot") == 3).cast("int"))
    terms = RG.promo_regression(rows.drop("slot").withColumn("slot", F.lit(None).cast("int")), ["new_years"])
    assert terms.filter("term = 'new_years'").count() == 2
    assert P.promo_residuals(rows, ["new_years"]).count() == rows.count()


def test_baseline_and_fit(modelled):
    rows = B.baseline_results(modelled)
    r = rows.first()
    assert r["baseline_qty"] == pytest.approx(r["trend"] + 0.05 * r["qty"])
    log = B.fit_log(rows).toPandas()
    pdf = rows.toPandas()
    for g, part in pdf.groupby("group_code"):
        got = log[log.group_code == g].iloc[0]
        assert got["r2"] == pytest.approx(np.corrcoef(part["fitted"], part["modelled_qty"])[0, 1] ** 2)
        assert got["rmse"] == pytest.approx(float(np.sqrt(((part["fitted"] - part["modelled_qty"]) ** 2).mean())))


def test_mode_price_table(group_rows, weeks):
    rows = group_rows([dict(yr_wk=w, qty=1.0, live_price=0.0 if w == 4 else 6.0) for w in (1, 2, 4, 6)])
    out = M.model_table(rows, weeks(8), params=ModelParams(price_fill="mode", head=0)).orderBy("yr_wk").collect()
    assert {r["live_price"] for r in out} == {6.0}
    assert len(PROMOS) == 7
