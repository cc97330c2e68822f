"""Cross features in the table, the joint fit, holidays, back-test, tail probabilities, series in two departments."""

import math
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalog as Q
from liftline.functions import beta_regularized, f_upper_tail, log_gamma, t_two_sided
from liftline.operators import features as X
from liftline.operators import gram as GR
from liftline.operators import holidays as H
from liftline.params import PROMOTIONS
from liftline.plans import backtest as BT
from liftline.plans import baseline as B
from liftline.plans import forecast as FC
from liftline.plans import insights as I
from liftline.plans import model_table as M
from liftline.plans import regression as RG
from liftline.sources import retail, sink

SF = "/root/testdata/sf0.001"
EDGE = "focus_group string, focus_dept int, target_group string, target_dept int, promos string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_rows(seed=5, weeks=120, groups=(("A", 1), ("A", 2), ("B", 1), ("C", 2))):
    rng = np.random.default_rng(seed)
    return [dict(group_code=g, dept=d, yr_wk=w, qty=float(rng.integers(20, 80)), sales=float(rng.integers(200, 800)),
                 pa_depth=float(rng.choice([0, 0, 5.25])), cpp_flag=int(rng.integers(0, 2)), digital_flag=int(rng.integers(0, 2)),
                 flyer_flag=int(rng.integers(0, 2)), page_location=rng.choice(["FRONT", "BACK", "INSIDE", None]))
            for g, d in groups for w in range(1, weeks + 1) if rng.random() > 0.05]


# --- series in two departments -------------------------------------------------------


def test_a_group_in_two_departments_is_two_series(group_rows, weeks):
    rows = random_rows()
    cal = weeks(120)

    def everything(part):
        panel = group_rows(part)
        dense = X.densify(panel, cal)
        table = M.model_table(panel, cal)
        history = B.baseline_results(table)
        plan = M.clean_panel(panel.filter("yr_wk > 100"), cal.filter("yr_wk > 100"))
        ahead = FC.forecast(history, plan)
        frames = (dense, X.week_index(panel), X.promo_lags(X.one_hot_page(panel)), table, B.fit_log(history), ahead, I.insights(history, ahead))
        return [sorted(map(str, (r.asDict() for r in Q.r6(f.select(sorted(f.columns))).collect()))) for f in frames]

    together = everything(rows)
    apart = [everything([r for r in rows if r["dept"] == d]) for d in (1, 2)]
    for whole, one, two in zip(together, *apart):
        assert whole == sorted(one + two)
    assert len(together[0]) == 4 * 120


def test_two_rows_of_one_series_and_week_fail(group_rows, weeks):
    panel = group_rows([dict(yr_wk=1), dict(yr_wk=2), dict(yr_wk=2)])
    with pytest.raises(Exception, match="two rows of one series and week"):
        X.densify(panel, weeks(3)).collect()


# --- cross features --------------------------------------------------------------------


def test_cross_features_in_the_table(spark, group_rows, weeks):
    rows = random_rows()
    edges = {"cann": spark.createDataFrame([("A", 1, "B", 1, "'cpp_flag', 'pa_depth'"), ("A", 1, "B", 1, "'cpp_flag', 'unknown'"),
                                            ("A", 2, "B", 1, "'page_front'"), ("A", 1, "gone", 1, "'cpp_flag'"), ("C", 2, "A", 2, None)], EDGE),
             "halo": spark.createDataFrame([("C", 2, "B", 1, "'digital_flag'"), ("A", 1, "C", 2, "'cpp_flag'")], EDGE)}
    panel, cal = group_rows(rows), weeks(120)
    names = X.cross_dictionary(panel, edges).persist()
    assert [(r["feature"], r["kind"], r["focus_dept"], r["focus_group"], r["promo"]) for r in names.filter("target_group = 'B'").orderBy("feature").collect()] == [
        (0, "cann", 1, "A", "cpp_flag"), (1, "cann", 1, "A", "pa_depth"), (2, "cann", 2, "A", "page_front"), (3, "halo", 2, "C", "digital_flag")]
    # A is in two departments, which bars it from halo features
    assert names.count() == 4
    for per_task in (1, 10_000):
        weekly = X.with_cross_features(panel, names, edges_per_task=per_task)
        got = M.model_table(weekly.drop("cross"), cal).select("dept", "group_code", "yr_wk", "qty", "trend", "modelled_qty")
        assert sorted(got.collect()) == sorted(M.model_table(panel, cal).select(got.columns).collect())
    table = M.model_table(panel, cal, dictionary=names)
    by_key = {(r["group_code"], r["dept"], r["yr_wk"]): r for r in rows}
    for r in table.collect():
        wanted = {}
        if r["group_code"] == "B":
            a1, a2, c = (by_key.get((g, d, r["yr_wk"])) for g, d in (("A", 1), ("A", 2), ("C", 2)))
            values = [a1 and a1["cpp_flag"], a1 and (5.3 if a1["pa_depth"] else 0), a2 and int(a2["page_location"] == "FRONT"), c and c["digital_flag"]]
            wanted = {i: v for i, v in enumerate(values) if v}
        assert r["cross"] == pytest.approx(wanted)
    assert {r["name"] for r in X.cross_long(table, names).collect()} == {"A_cpp_flag_CANN_PROMO", "A_pa_depth_CANN_PROMO", "A_page_front_CANN_PROMO", "C_digital_flag_HALO_PROMO"}


def test_stored_panel_needs_no_shuffle(spark):
    weekly = sink.keyed(Q.history_panel(spark, SF), ("dept", "group_code"), 4)
    plain = M.model_table(weekly, Q.history_calendar(spark, SF), None, Q.PARAMS)
    plan = plan_of(plain)
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    names = sink.shared(X.cross_dictionary(weekly, Q.both_edges(spark, SF)))
    crossed = plan_of(M.model_table(weekly, Q.history_calendar(spark, SF), None, Q.PARAMS, names))
    # of the panel only the focus rows are dealt to their targets
    assert len(re.findall(r"Exchange hashpartitioning\(dept[^)]*group_code", crossed)) == 1
    assert plain.count() == M.model_table(Q.history_panel(spark, SF), Q.history_calendar(spark, SF), None, Q.PARAMS).count()


def test_week_bounds_reach_the_scan(spark):
    for frame in (Q.QUERIES["scan_panel"](spark, SF), Q.QUERIES["scan_future"](spark, SF), Q.QUERIES["future_targets"](spark, SF)):
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", plan_of(frame))
    first, after = retail.line_days(199853, 199902)
    assert (first, after) == (date(1998, 10, 1), date(1999, 4, 7))
    whole = retail.group_panel(spark, SF).filter("yr_wk BETWEEN 199610 AND 199720")
    assert sorted(whole.collect(), key=str) == sorted(retail.group_panel(spark, SF, (199610, 199720)).collect(), key=str)


def test_associations_read_the_lines_once(spark):
    assert plan_of(Q.QUERIES["association_matrix"](spark, SF)).count("l_returnflag") > 0
    assert len(re.findall(r"FileScan parquet \[l_partkey", plan_of(Q.QUERIES["association_matrix"](spark, SF)))) == 1


# --- joint fit -------------------------------------------------------------------------


def test_joint_fit_against_numpy(spark, group_rows, weeks):
    edges = {"cann": spark.createDataFrame([("A", 1, "B", 1, "'cpp_flag', 'pa_depth'"), ("B", 1, "C", 2, "'digital_flag'")], EDGE),
             "halo": spark.createDataFrame([("C", 2, "B", 1, "'digital_flag'")], EDGE)}
    panel, cal = group_rows(random_rows(8, 160)), weeks(160)
    names = X.cross_dictionary(panel, edges).persist()
    table = M.model_table(panel, cal, dictionary=names).persist()
    got = RG.joint_regression(table, names).toPandas()
    assert set(got["kind"]) == {"own", "cann", "halo"}
    terms = RG.own_terms()
    for (d, g), pdf in table.toPandas().groupby(["dept", "group_code"]):
        x = {n: (pdf["slot"] == int(n[5:])).to_numpy(float) if n.startswith("week_") else np.ones(len(pdf)) if n == "intercept"
             else pdf[n].fillna(0).to_numpy(float) for n in terms}
        for r in names.filter((F.col("target_group") == g) & (F.col("target_dept") == d)).collect():
            x[r["name"]] = np.array([m.get(r["feature"], 0.0) for m in pdf["cross"]])
        mine = got[(got.group_code == g) & (got.dept == d)].set_index("term")
        design = np.column_stack([x[t] for t in mine.index])
        whole = np.column_stack(list(x.values()))
        assert np.linalg.matrix_rank(design) == design.shape[1] == np.linalg.matrix_rank(whole)
        y = pdf["modelled_qty"].to_numpy()
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        rss = ((y - design @ beta) ** 2).sum()
        std = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / (len(y) - len(beta)))
        np.testing.assert_allclose(mine["coef"], beta, rtol=1e-5, atol=1e-6)
        np.testing.assert_allclose(mine["std_error"], std, rtol=1e-5)
        assert mine["rss"].iloc[0] == pytest.approx(rss) and mine["dof"].iloc[0] == len(y) - len(beta)
        assert mine["r2"].iloc[0] == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    relations = RG.joint_relations(RG.joint_regression(table, names), "cann").collect()
    assert {(r["group_code"], r["focus_group"]) for r in relations} == {("B", "A"), ("C", "B")}
    assert relations[0]["cpp_flag_focus_coef"] is not None or relations[1]["cpp_flag_focus_coef"] is not None


def test_sums_of_parts_merge_and_spanned_terms_go(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 3))])
    x = np.column_stack([x, 2 * x[:, 1] - x[:, 2]])
    y = x @ [1, 2, 0, -1, 0] + rng.normal(size=50)
    assert GR.swept(x.T @ x) == [0, 1, 2, 3]
    rows = spark.createDataFrame([("k", *map(float, r), float(t)) for r, t in zip(x, y)], "k string, a double, b double, c double, d double, e double, y double")
    vector = GR.sparse_vector([(F.lit(i), F.col(c)) for i, c in enumerate("abcde")])
    staged = rows.withColumn("v", vector)
    sums = [GR.sums_of_products(part, ["k"], "v", "y") for part in (staged, staged.limit(20), staged.offset(20))]
    whole, merged = ({(r["i"], r["j"]): r["s"] for r in f.collect()} for f in (sums[0], sums[1].unionByName(sums[2]).groupBy("k", "i", "j").agg(F.sum("s").alias("s"))))
    assert whole == pytest.approx(merged)
    fit = {r["term"]: r["coef"] for r in GR.least_squares(staged, ["k"], "v", "y").collect()}
    assert [fit[i] for i in range(4)] == pytest.approx(np.linalg.lstsq(x[:, :4], y, rcond=None)[0].tolist()) and 4 not in fit
    assert GR.least_squares(staged.limit(0), ["k"], "v", "y").count() == 0
    assert "Python" not in plan_of(sums[0])


# --- tail probabilities ------------------------------------------------------------------


def test_tail_probabilities(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    for x in (1e-3, 0.5, 1.0, 7.25, 150.0, 4000.0):
        assert value(log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    # closed forms: I_x(a, 1) = x^a, I_x(1, b) = 1 - (1-x)^b; F with 2 numerator degrees: (1 + 2f/d)^(-d/2)
    for x, a in ((0.3, 2.5), (0.99, 40.0), (1e-4, 0.5)):
        assert value(beta_regularized(F.lit(x), F.lit(a), F.lit(1.0))) == pytest.approx(x ** a, rel=1e-11)
        assert value(beta_regularized(F.lit(x), F.lit(1.0), F.lit(a))) == pytest.approx(1 - (1 - x) ** a, rel=1e-10)
    for f, d in ((0.5, 7), (3.0, 30), (12.0, 145)):
        assert value(f_upper_tail(F.lit(f), F.lit(2), F.lit(d))) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-9)
    # tabled points: 5 % of F(5, 10) and F(52, 146), 2.5 % each side of t(10)
    assert value(f_upper_tail(F.lit(3.3258345304130126), F.lit(5), F.lit(10))) == pytest.approx(0.05, rel=1e-9)
    assert value(t_two_sided(F.lit(2.2281388519649385), F.lit(10))) == pytest.approx(0.05, rel=1e-9)
    assert value(t_two_sided(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, rel=1e-9)
    assert [value(f_upper_tail(F.lit(v), F.lit(3), F.lit(d))) for v, d in ((0.0, 4), (1.0, 0))] == [1.0, None]
    assert value(f_upper_tail(F.lit(None).cast("double"), F.lit(3), F.lit(4))) is None
    # the sum of both tails is one
    for f, a, b in ((0.7, 52, 146), (1.9, 1, 300), (40.0, 3, 5)):
        low = value(beta_regularized(F.lit(a * f / (a * f + b)), F.lit(a / 2), F.lit(b / 2)))
        assert low + value(f_upper_tail(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(1, abs=1e-12)


# --- holidays ---------------------------------------------------------------------------


def easter(year):
    a, (b, c) = year % 19, divmod(year, 100)
    (d, e), f = divmod(b, 4), (b + 8) // 25
    h = (19 * a + b - d - (b - f + 1) // 3 + 15) % 30
    i, k = divmod(c, 4)
    m = (a + 11 * h + 22 * ((32 + 2 * e + 2 * i - h - k) % 7)) // 451
    month, day = divmod(h + (32 + 2 * e + 2 * i - h - k) % 7 - 7 * m + 114, 31)
    return date(year, month, day + 1)


def test_moving_days(spark):
    years = spark.range(1800, 2200).select(F.col("id").cast("int").alias("y"), H.easter(F.col("id").cast("int")).alias("e"))
    assert all(r["e"] == easter(r["y"]) for r in years.collect())
    for name, day in (("thanksgiving_day", date(2023, 10, 9)), ("labor_day", date(2025, 9, 1)), ("commonwealth_day", date(2022, 3, 14)),
                      ("good_friday", date(2024, 3, 29)), ("canada_day", date(2000, 7, 1))):
        got = spark.range(1).select(H.holiday_day(H.HOLIDAYS[name], F.lit(day.year)).alias("d")).first()["d"]
        assert got == day


def test_event_weeks_with_lead_and_lag(weeks):
    cal = weeks(110)  # from 3 January 2000
    rows = H.holiday_weeks(cal, lead=2, lag=1).orderBy("yr_wk").collect()
    assert len(rows) == 110 and len(H.HOLIDAYS) == 18
    assert [c for c in rows[0].asDict() if c != "yr_wk"].sort() == H.holiday_columns(lead=2, lag=1).sort()
    start = date(2000, 1, 3)
    for name, rule in H.HOLIDAYS.items():
        hit = [i for i, r in enumerate(rows) if r[name]]
        for i in hit:
            assert rows[i - 1][f"{name}_before_1"] == 1 or i == 0
            assert rows[i - 2][f"{name}_before_2"] == 1 or i < 2
            assert i == 109 or rows[i + 1][f"{name}_after_1"] == 1
        if isinstance(rule, tuple) and len(rule) == 2:
            assert hit == [i for i in range(110) if any((d.month, d.day) == rule for d in (start + timedelta(7 * i + j) for j in range(7)))]
        elif rule == -2:
            assert hit == [(easter(y) - timedelta(2) - start).days // 7 for y in (2000, 2001)]
    given = cal.sparkSession.createDataFrame([("fair", date(2000, 1, 12))], "holiday string, day date")
    assert [r["fair"] for r in H.holiday_weeks(cal, given, ["fair"]).orderBy("yr_wk").take(3)] == [0, 1, 0]


def test_result_frame_has_all_columns(group_rows, weeks):
    cal = weeks(130)
    table = M.model_table(group_rows(random_rows(3, 130, (("A", 1), ("B", 2)))), cal, holidays=H.holiday_weeks(cal)).persist()
    coef = RG.promo_regression(table, H.HOLIDAYS).persist()
    assert coef.filter("term = 'christmas_day'").count() == 2
    wide = RG.model_results(B.baseline_results(table), coef, H.HOLIDAYS)
    assert len(wide.columns) == 167 and wide.filter("christmas_day_coef <> 0").count() == wide.count() == table.count()
    classes = RG.insight_classes(coef)
    assert len(classes.columns) == 1 + 15 and classes.count() == 2
    named = [n for r in classes.collect() for c in RG.CLASSES for n in r[c].split(", ") if n]
    assert len(named) == coef.filter(F.col("term").isin(*PROMOTIONS)).count()


# --- back-test ----------------------------------------------------------------------------


def test_back_test_equals_a_run_on_the_earlier_weeks(group_rows, weeks):
    rows = random_rows(4, 130, (("A", 1), ("A", 2)))
    cal, horizon = weeks(130), 6
    prepared = M.prepared_rows(group_rows(rows), cal).persist()
    origins = BT.origin_weeks(range(1, 131), horizon, 2, 9)
    assert origins == {124: 130, 115: 121}
    got = {(r["origin"], r["dept"], r["yr_wk"]): (r["forecast"], r["actual"]) for r in BT.rolling_forecasts(prepared, origins).collect()}
    assert len(got) == 2 * 2 * horizon
    clean = {(r["dept"], r["yr_wk"]): r["modelled_qty"] for r in prepared.collect()}
    for origin, until in origins.items():
        before = M.model_table(group_rows([r for r in rows if r["yr_wk"] <= origin]), cal.filter(F.col("yr_wk") <= origin))
        plan = prepared.filter(F.col("yr_wk").between(origin + 1, until))
        for r in FC.forecast(B.baseline_results(before), plan).collect():
            forecast, actual = got[origin, r["dept"], r["yr_wk"]]
            assert forecast == pytest.approx(r["qty"]) and actual == clean[r["dept"], r["yr_wk"]]
    errors = {r["dept"]: r for r in BT.forecast_errors(BT.rolling_forecasts(prepared, origins)).collect()}
    for d in (1, 2):
        mine = [v for (o, dept, w), v in got.items() if dept == d]
        assert errors[d]["forecast_wmape"] == pytest.approx(sum(abs(f - a) for f, a in mine) / sum(a for _, a in mine))
        assert errors[d]["forecast_mape"] == pytest.approx(np.mean([abs(f - a) / a for f, a in mine if a > 0]))
        assert errors[d]["n_forecasts"] == 2 * horizon


# --- the job --------------------------------------------------------------------------------


def test_job_writes_frames_of_chosen_groups(spark, tmp_path):
    from liftline.plans import job as J

    w = Q.window(spark, SF)
    one = F.col("target_group") == "Brand#11"
    inputs = Q.job_inputs(spark, SF)
    inputs = J.JobInputs(inputs.panel, inputs.cal, {k: e.filter(one) for k, e in inputs.edges.items()}, inputs.allowed_lags, params=Q.PARAMS)
    counts = {r["frame"]: r["rows"] for r in J.run_job(inputs, w, str(tmp_path)).collect()}
    assert tuple(counts) == J.FRAMES
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in J.FRAMES}
    assert {n: f.count() for n, f in read.items()} == counts
    past = inputs.panel.filter(F.col("yr_wk").between(w.start, w.end))
    ahead = inputs.panel.filter(F.col("yr_wk").between(w.forecast_start, w.forecast_end) & (F.col("flyer_flag") == 1))
    now = past.filter((F.col("yr_wk") == w.end) & (F.greatest("flyer_flag", "cpp_flag", "digest_flag", "digital_flag") > 0))
    targets = {r["group_code"] for r in ahead.select("group_code").distinct().collect()}
    wanted = targets | {r["group_code"] for r in now.select("group_code").distinct().collect()} | {"Brand#11"}
    named = {n: {r["group_code"] for r in f.select("group_code").distinct().collect()} for n, f in read.items()}
    known = {r["group_code"] for r in past.select("group_code").distinct().collect()}
    assert named["results"] == named["fit_log"] == named["insights"] >= wanted & known and named["forecast"] == targets & known
    assert len(known) > len(wanted & known) or named["results"] == known
    assert named["cann"] <= {"Brand#11"} and named["halo"] <= {"Brand#11"} and counts["cann"] + counts["halo"] > 0
    assert {r["scorecard_wk"] for f in read.values() for r in f.select("scorecard_wk").distinct().collect()} == {w.end}
    log = read["fit_log"].filter("forecast_wmape IS NOT NULL AND p_value BETWEEN 0 AND 1")
    assert log.count() > 0 and read["results"].filter("is_forecast <> 0").count() == 0


def test_job_of_one_department(spark):
    frames = Q.J.job_frames(Q.job_inputs(spark, SF), Q.window(spark, SF), [3])
    assert {r["dept"] for n in ("results", "forecast", "insights") for r in frames[n].select("dept").distinct().collect()} == {3}
