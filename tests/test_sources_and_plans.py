"""Readers, writers, statistics, physical plans and registered queries."""

import os
import re
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import catalog as Q
from checks.compare import compare, duck
from liftline.operators import calendar as C
from liftline.operators import stats as S
from liftline.sources import sink, tables

SF = "/root/testdata/sf0.001"


def test_calendar_bounds(weeks):
    w = C.week_window(weeks(40), horizon=12, history=20)
    assert (w.start, w.end, w.forecast_start, w.forecast_end) == (8, 28, 29, 40)


def test_write_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "dept int, scorecard_wk int, x string")
    sink.write_frame(one, path)
    sink.write_frame(one.filter("dept = 2").withColumn("x", F.lit("c")), path)
    assert {(r["dept"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    sink.write_frames({"e": one.limit(0).drop("dept", "scorecard_wk")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["x"]


def test_empty_partitioned_frame_can_be_read(spark, tmp_path):
    path, one = str(tmp_path / "none"), spark.createDataFrame([(1, 7, "a")], "dept int, scorecard_wk int, x string")
    rows = sink.write_frames({"none": one.limit(0), "some": one}, str(tmp_path))
    assert rows == {"none": 0, "some": 1}
    back = sink.read_frame(spark, path, one.schema)
    assert back.count() == 0 and back.schema == one.schema
    assert sink.read_frame(spark, str(tmp_path / "some"), one.schema).collect() == one.collect()
    # a target is emptied whatever its partitions, and takes rows again
    sink.truncate_target(spark, one, str(tmp_path / "some"))
    assert sink.read_frame(spark, str(tmp_path / "some"), one.schema).count() == 0
    sink.write_frame(one, str(tmp_path / "some"))
    assert sink.read_frame(spark, str(tmp_path / "some"), one.schema).count() == 1


def test_counts_come_from_the_run_that_writes(spark, tmp_path):
    clean, seen = S.counted_cleaning(spark.range(10).withColumn("ok", F.when(F.col("id") < 9, F.col("id") > 2)), F.col("ok"))
    sink.write_frame(clean, str(tmp_path / "clean"), ())
    assert seen.get == {"rows_before": 10, "rows_after": 6} and spark.read.parquet(str(tmp_path / "clean")).count() == 6


def test_calendar_as_a_plan(spark):
    from liftline.sources import retail
    lazy, fetched = (f(spark, SF).orderBy("yr_wk").collect() for f in (retail.calendar_plan, retail.calendar))
    assert lazy == fetched and "lineitem" in plan_of(retail.calendar_plan(spark, SF))


def test_package_is_shipped_with_its_functions(tmp_path):
    """A job started from another folder: Python workers do not find the package on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
from datetime import datetime, timedelta
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from liftline.plans import levels
from liftline.operators import gram
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.range(1, 81).selectExpr("1 AS dept", "'G' AS group_code", "cast(id AS int) AS t", "double(if(id > 40, 30, 10)) AS modelled_qty")
print("breaks", levels.level_shifts(rows).first()["breaks"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "breaks [40]" in out.stdout, out.stderr[-2000:]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.createDataFrame(
        [("A", "1", 1, "10.5", "bad", "3", "4", 0, 0, 0)], tables.PRICE_PANEL)
    sink.write_frame(rows, path, (), "csv")
    back = tables.cast_columns(tables.read_csv_panel(spark, path), doubles=["regular_price", "retail_price"])
    assert (back.first()["regular_price"], back.first()["retail_price"]) == (10.5, None)


def test_names_and_stamp(spark):
    df = spark.createDataFrame([(1, 2)], ["T1.Group.Code", "QTY"])
    assert tables.normalize_columns(df, "t1").columns == ["group_code", "qty"]
    assert tables.stamp(df, 5, 1, 9).columns[-3:] == ["scorecard_wk", "is_forecast", "dept"]


def test_skew_counts_empty_partitions(spark):
    one = spark.range(10).repartition(1)
    assert S.partition_skew(one, 4).first()["min_rows"] == 0
    assert S.partition_skew(one).first()["skew"] == 1.0


def test_constant_columns_have_no_association(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 3.0, "a")], "x double, y double, c string")
    assert [r["value"] for r in S.association_matrix(df, ["x", "y"], ["c"]).collect()] == [None, None, 0.0]
    # pairs with an unknown side count for neither covariance nor deviation
    holes = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (900.0, None), (None, -70.0)], "x double, y double")
    assert [round(r["value"], 9) for r in S.association_matrix(holes, ["x", "y"], []).collect()] == [1.0]


def test_output_contracts(spark):
    from liftline import schema
    from liftline.plans import baseline, elasticity, insights, pull_forward
    r, ahead = Q.results_and_plan(spark, SF)
    frames = {
        "METRICS": elasticity.elasticity_metrics(Q.panel(spark, SF)),
        "INSIGHTS": insights.insights(r, ahead), "FIT_LOG": baseline.fit_log(r),
        "PULL_FORWARD": pull_forward.pull_forward(Q.full_lag_table(spark, SF))}
    for name, df in frames.items():
        want = [(f.name, f.dataType) for f in getattr(schema, name).fields]
        assert [(f.name, f.dataType) for f in df.schema.fields] == want, name


def test_shared_frame_is_cut_from_its_source(spark):
    df = sink.shared(Q.gpanel(spark, SF))
    assert df.count() == Q.gpanel(spark, SF).count()
    assert "FileScan" not in plan_of(df)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hash_exchanges(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_elasticity_shuffles_once_per_series(spark):
    plan = plan_of(Q.QUERIES["elasticity_metrics"](spark, SF))
    # one for the sums over order lines, one for the series
    assert hash_exchanges(plan) == 2 and "Python" not in plan


def test_model_table_shuffles_once_per_group(spark):
    from liftline.plans import model_table as M
    rows = Q.history_panel(spark, SF)
    plan = plan_of(M.model_table(rows, Q.history_calendar(spark, SF), None, Q.PARAMS))
    assert hash_exchanges(plan) == 2 and "Python" not in plan


@pytest.mark.parametrize("name", ["forecast", "insights", "add_cann_features", "mann_kendall", "fit_log"])
def test_native_plans(spark, name):
    plan = plan_of(Q.QUERIES[name](spark, SF))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lines_are_read_by_column(spark):
    plan = plan_of(Q.gpanel(spark, SF).select("group_code", "yr_wk", "qty"))
    scan = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "l_tax" not in scan and "l_orderkey" not in scan


@pytest.fixture(scope="module")
def con():
    return duck(SF)


FEW = ["scan_edges", "densify", "add_halo_features", "iqr_bounds", "smooth_regular_price", "promo_multipliers",
       "elasticity_metrics", "model_table", "repair_anomalies_seasonal", "promo_lift", "fit_log", "forecast",
       "insights", "pull_forward", "association_matrix", "winsorize_outliers", "groups_of_interest", "model_table_cross",
       "mann_kendall"]


@pytest.mark.parametrize("name", list(Q.QUERIES) if os.environ.get("LIFTLINE_ALL") else FEW)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(Q.ORACLE) <= set(Q.QUERIES)


def test_bind_rows_holds_the_weeks_of_all_departments(spark, tmp_path):
    brands = range(1, 8)
    spark.createDataFrame([(k, f"Brand#{k}") for k in brands], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(k, 1, 2.0, 20.0, 0.1, "N", "O", datetime(2024, 1, 1) + timedelta(weeks=w)) for k in brands for w in range(20)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = Q.QUERIES["bind_rows"](spark, str(tmp_path)).collect()
    weeks = sorted({r["yr_wk"] for r in rows if r["yr_wk"]})
    assert weeks and max(weeks) < 202420  # the last weeks are the horizon
    for kind in ("halo", "cann"):
        weekly = [(r["dept"], r["group_code"], r["yr_wk"]) for r in rows if r["kind"] == kind and r["yr_wk"]]
        assert sorted(weekly) == sorted((k % 5, f"Brand#{k}", w) for k in brands for w in weeks)
        assert {r["focus_group"] for r in rows if r["kind"] == kind and r["promo"]} == {f"Brand#{k}" for k in brands}
