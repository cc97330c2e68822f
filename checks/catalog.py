"""Every registered query with the SQL that checks it.

Queries take (spark, sf_dir) and read whole tables. Doubles are rounded to six
decimals on both sides (money to three), since float sums depend on row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.functions import (
    active_promos, in_weeks, metric_round, multiplier, parse_quoted_list, quoted_list, safe_log, to_number,
)
from liftline.operators import calendar as C
from liftline.operators import clean as K
from liftline.operators import features as X
from liftline.operators import holidays as H
from liftline.operators import levels as L
from liftline.operators import regression as R
from liftline.operators import selection as G
from liftline.operators import stats as S
from liftline.operators import trend as T
from liftline.operators.holidays import HOLIDAYS
from liftline.params import (
    DEPTHS, FLAGS, LAG_COLUMNS, LAGS, PAGES, PROMOS, PROMOTIONS, SLOTS, AnomalyParams, ModelParams,
)
from liftline.plans import backtest as BT
from liftline.plans import baseline as B
from liftline.plans import elasticity as E
from liftline.plans import forecast as FC
from liftline.plans import insights as I
from liftline.plans import job as J
from liftline.plans import levels as LV
from liftline.plans import model_table as M
from liftline.plans import pull_forward as P
from liftline.plans import regression as RG
from liftline.schema import PRICE_PANEL
from liftline.sources import retail, sink, tables

from .sql import ACTIVE, ANY_PROMO, BLOCKS, SHOCK_WEEKS, TARGET, W, center, fit_blocks, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **local: str):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, **local)
        return fn
    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals, without negative zero."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rnd(*columns: str, digits: int = 6) -> str:
    """SQL select items rounded to six decimals: 'a', or 'expr AS a'."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round(({expr or c})::DOUBLE, {digits}) + 0.0 AS {name or c}")
    return ", ".join(out)


def five_digits(df: DataFrame, columns) -> DataFrame:
    """Fitted values as text of five significant digits, for they span many magnitudes; 0 for noise."""
    return df.withColumns({c: F.when(F.abs(c) < 1e-6, "0").when(F.col(c).isNotNull(), F.format_string("%.4e", c)) for c in columns})


def sig(*columns: str) -> str:
    """SQL select items as five_digits gives them: 'a', or 'expr AS a'."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        x = f"({expr or c})::DOUBLE"
        out.append(f"CASE WHEN abs({x})<1e-6 THEN '0' WHEN {x} IS NOT NULL THEN printf('%.4e', {x}) END AS {name or c}")
    return ", ".join(out)


# --- shared inputs -----------------------------------------------------------

def panel(spark, d):
    return retail.series_panel(spark, d)


def gpanel(spark, d, weeks=None):
    return retail.group_panel(spark, d, weeks)


_CALENDARS: dict = {}


def cal(spark, d):
    """The tables' calendar; its two dates are read once per session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CALENDARS:
        c = retail.calendar(spark, d)
        _CALENDARS[key] = (c, C.week_window(c))
    return _CALENDARS[key][0]


def window(spark, d):
    cal(spark, d)
    return _CALENDARS[(spark.sparkContext.applicationId, d)][1]


def history_calendar(spark, d):
    w = window(spark, d)
    return cal(spark, d).filter(F.col("yr_wk").between(w.start, w.end))


def history_weeks(spark, d):
    return [r["yr_wk"] for r in history_calendar(spark, d).select("yr_wk").collect()]


def future_calendar(spark, d):
    w = window(spark, d)
    return cal(spark, d).filter(F.col("yr_wk").between(w.forecast_start, w.forecast_end))


def history_panel(spark, d, source=None):
    w = window(spark, d)
    return tables.scan_panel(source if source is not None else gpanel(spark, d, (w.start, w.end)), w.start, w.end)


def future_panel(spark, d, source=None):
    """Planned weeks: promotions known, quantities withheld."""
    w = window(spark, d)
    rows = tables.scan_panel(source if source is not None else gpanel(spark, d, (w.forecast_start, w.forecast_end)),
                             w.forecast_start, w.forecast_end)
    return rows.withColumns({"qty": F.lit(0.0), "sales": F.lit(0.0)})


PARAMS = ModelParams(anomaly=AnomalyParams(shock_weeks=SHOCK_WEEKS))


def hclean(spark, d, **kw):
    rows = K.round_depths(history_panel(spark, d).withColumn("modelled_qty", F.col("qty")))
    return M.clean_panel(rows, history_calendar(spark, d), **kw)


def fclean(spark, d, source=None):
    return M.clean_panel(K.round_depths(future_panel(spark, d, source)), future_calendar(spark, d))


def table(spark, d, params=PARAMS, source=None):
    return M.model_table(history_panel(spark, d, source), history_calendar(spark, d),
                         retail.pull_forward_edges(spark, d), params)


def full_lag_table(spark, d):
    return M.model_table(history_panel(spark, d), history_calendar(spark, d), None, PARAMS)


def results(spark, d, source=None):
    return B.baseline_results(table(spark, d, source=source))


def results_and_plan(spark, d):
    """Results and forecast from one pass over the order lines.

    Both read the weekly panel, and the forecast reads the results, so each is
    computed once.
    """
    weekly = sink.shared(gpanel(spark, d))
    r = sink.shared(results(spark, d, weekly))
    return r, FC.forecast(r, fclean(spark, d, weekly))


def planned(spark, d):
    return results_and_plan(spark, d)[1]


def blocks(spark, d):
    return E.block_table(E.clean_series(panel(spark, d)))


# --- scans, sources, sinks ----------------------------------------------------

PANEL_COLS = "upc, store, yr_wk, regular_price, retail_price, units, sales, instore_promo, flyer, cpp"


@query("read_csv_panel", "SELECT upc, store, yr_wk, regular_price, retail_price, units, "
       "sales, instore_promo, flyer, cpp FROM panel")
def _(spark, d):
    path = f"{sink.shared_dir(spark)}/price_panel_csv-{uuid.uuid4().hex}"
    names = PRICE_PANEL.fieldNames()
    sink.write_frame(panel(spark, d).select(*names), path, (), "csv")
    rows = tables.read_csv_panel(spark, path)
    return tables.cast_columns(rows, doubles=["regular_price", "retail_price", "units", "sales"])


@query("scan_panel", """SELECT dept, group_code, yr_wk, qty, sales FROM gpanel
  WHERE yr_wk BETWEEN 199801 AND 199952 AND dept IN (1, 3)""")
def _(spark, d):
    return tables.scan_panel(gpanel(spark, d, (199801, 199952)), 199801, 199952, [1, 3]).select(
        "dept", "group_code", "yr_wk", "qty", "sales")


@query("scan_edges", """
SELECT 'cann' AS kind, focus_group, target_group, focus_dept, target_dept, unnest(promos) AS promo
FROM cann_edges WHERE focus_dept IN (0, 2)
UNION ALL SELECT 'halo', focus_group, target_group, focus_dept, target_dept, unnest(promos)
FROM halo_edges WHERE focus_dept IN (0, 2)""")
def _(spark, d):
    def side(kind):
        return tables.scan_edges(retail.relation_edges(spark, d, kind), [0, 2]).select(
            F.lit(kind).alias("kind"), "focus_group", "target_group", "focus_dept", "target_dept",
            F.explode("promos").alias("promo"))
    return side("cann").unionByName(side("halo"))


@query("scan_future", "SELECT dept, group_code, yr_wk, " + ", ".join(FLAGS) + " FROM fpanel")
def _(spark, d):
    return future_panel(spark, d).select("dept", "group_code", "yr_wk", *FLAGS)


@query("future_targets", "SELECT DISTINCT group_code, dept FROM fpanel WHERE flyer_flag=1")
def _(spark, d):
    w = window(spark, d)
    weeks = (w.forecast_start, w.forecast_end)
    return tables.future_targets(gpanel(spark, d, weeks), *weeks)


@query("normalize_columns", "SELECT upc AS panel_upc, store AS st, yr_wk AS yr_week, units AS total_units FROM panel")
def _(spark, d):
    raw = panel(spark, d).select(
        F.col("upc").alias("PANEL.UPC"), F.col("store").alias("RAW.ST"), F.col("yr_wk").alias("Yr_Week"),
        F.col("units").alias("TOTAL.UNITS"))
    return tables.normalize_columns(raw, "raw")


@query("cast_columns", """SELECT event_id::VARCHAR AS event_id, user_id::INTEGER AS user_id,
  try_cast(event_type AS DOUBLE) AS event_type, try_cast(value AS DOUBLE) AS value FROM events""")
def _(spark, d):
    ev = tables.read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return tables.cast_columns(ev, strings=["event_id"], ints=["user_id"], doubles=["event_type", "value"])


@query("write_frames", "SELECT " + rnd("qty", "sales") + """, dept, group_code, yr_wk,
  (SELECT w FROM wk_end) AS scorecard_wk FROM gpanel""")
def _(spark, d):
    root = f"{sink.shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    out = tables.stamp(gpanel(spark, d).select("dept", "group_code", "yr_wk", "qty", "sales"), window(spark, d).end)
    sink.write_frames({"panel": out}, root)
    return r6(sink.read_frame(spark, f"{root}/panel", out.schema))


@query("truncate_target", "SELECT dept, group_code, yr_wk, qty FROM fpanel")
def _(spark, d):
    # an earlier run's rows go, whatever their partitions; then this run's rows are written
    path = f"{sink.shared_dir(spark)}/target-{uuid.uuid4().hex}"
    earlier = history_panel(spark, d).select("dept", "group_code", "yr_wk", "qty")
    sink.write_frame(earlier, path)
    sink.truncate_target(spark, earlier, path)
    w = window(spark, d)
    sink.write_frame(gpanel(spark, d, (w.forecast_start, w.forecast_end)).select("dept", "group_code", "yr_wk", "qty"), path)
    return sink.read_frame(spark, path, earlier.schema)


@query("write_empty_frame", "SELECT dept, group_code, yr_wk, qty FROM gpanel WHERE qty < 0")
def _(spark, d):
    path = f"{sink.shared_dir(spark)}/empty-{uuid.uuid4().hex}"
    none = gpanel(spark, d).filter("qty < 0").select("dept", "group_code", "yr_wk", "qty")
    sink.write_frame(none, path)
    return sink.read_frame(spark, path, none.schema)


@query("register_view", "SELECT dept, group_code, count(*) AS n, " + rnd("sum(qty) AS qty") + " FROM gpanel GROUP BY 1, 2")
def _(spark, d):
    stored = sink.keyed(gpanel(spark, d), ("dept", "group_code"))
    tables.register_view(stored, "group_panel")
    return r6(spark.sql("SELECT dept, group_code, count(*) AS n, sum(qty) AS qty FROM group_panel GROUP BY dept, group_code"))


@query("stamp", "SELECT dept, group_code, yr_wk, (SELECT w FROM wk_end) AS scorecard_wk, 1 AS is_forecast FROM fpanel")
def _(spark, d):
    rows = future_panel(spark, d).select("dept", "group_code", "yr_wk")
    return tables.stamp(rows, window(spark, d).end, is_forecast=1)


# --- calendar -------------------------------------------------------------------

@query("last_week", "SELECT max(yr_wk) AS week_end FROM gpanel")
def _(spark, d):
    return C.last_week(gpanel(spark, d))


def run_end(c):
    """Last week of the history as a scalar column, inside the plan: the last 12 weeks are the horizon."""
    return C.week(C.history_start(c, C.week(C.last_week(c)), 12))


@query("history_start", "SELECT w AS week_start FROM wk_start_")
def _(spark, d):
    c = retail.calendar_plan(spark, d)
    return C.history_start(c, run_end(c))


@query("horizon_end", """SELECT max(yr_wk) AS forecast_end FROM (SELECT yr_wk FROM cal
  WHERE yr_wk > (SELECT w FROM wk_end) ORDER BY yr_wk LIMIT 12)""")
def _(spark, d):
    c = retail.calendar_plan(spark, d)
    return C.horizon_end(c, run_end(c))


@query("horizon_start", "SELECT min(yr_wk) AS forecast_start FROM cal WHERE yr_wk > (SELECT w FROM wk_end)")
def _(spark, d):
    c = retail.calendar_plan(spark, d)
    return C.horizon_start(c, run_end(c))


@query("calendar_slice", """SELECT DISTINCT yr_wk, start_date, end_date FROM cal
  WHERE yr_wk BETWEEN (SELECT w FROM wk_start_) AND (SELECT w FROM wk_end)""")
def _(spark, d):
    c = retail.calendar_plan(spark, d)
    return C.calendar_slice(c, C.week(C.history_start(c, run_end(c))), run_end(c))


# --- projections, filters ---------------------------------------------------------

@query("drop_incomplete", """SELECT upc, store, yr_wk, retail_price AS regular_price, units, sales FROM panel
  WHERE retail_price IS NOT NULL AND cpp IS NOT NULL""")
def _(spark, d):
    # retail price as the required price, and units unreadable where the coupon flag is unknown
    units = F.when(F.col("cpp").isNull(), "n/a").otherwise(F.col("units").cast("string"))
    raw = panel(spark, d).select("upc", "store", "yr_wk", F.col("retail_price").alias("regular_price"),
                                 units.alias("units"), "sales")
    return K.drop_incomplete(raw)


@query("drop_negative", "SELECT upc, store, yr_wk, net_units, " + rnd("net_sales")
       + " FROM panel WHERE net_units >= 0 AND net_sales >= 0")
def _(spark, d):
    rows = K.drop_negative(panel(spark, d), ("net_units", "net_sales"))
    return r6(rows.select("upc", "store", "yr_wk", "net_units", "net_sales"))


@query("effective_price", "SELECT upc, store, yr_wk, " + rnd("regular_price", "retail_price") + " FROM esrows")
def _(spark, d):
    return r6(K.effective_price(panel(spark, d)).select("upc", "store", "yr_wk", "regular_price", "retail_price"))


@query("promo_type", "SELECT upc, store, yr_wk, promo_type FROM esrows")
def _(spark, d):
    return K.with_promo_type(panel(spark, d)).select("upc", "store", "yr_wk", "promo_type")


@query("round_depths", "SELECT group_code, yr_wk, " + ", ".join(
    f"round({c}::DECIMAL(18,6),1)::DOUBLE AS {c}" for c in DEPTHS) + " FROM gpanel")
def _(spark, d):
    return K.round_depths(gpanel(spark, d)).select("group_code", "yr_wk", *DEPTHS)


@query("clamp_nonneg", "SELECT upc, store, yr_wk, " + rnd("greatest(net_sales, 0) AS sales")
       + " , greatest(net_units, 0)::DOUBLE AS modelled_qty FROM panel")
def _(spark, d):
    rows = panel(spark, d).select("upc", "store", "yr_wk", F.col("net_sales").alias("sales"),
                                  F.col("net_units").alias("modelled_qty"))
    return r6(K.clamp_measures(rows))


@query("one_hot_page", "SELECT group_code, yr_wk, " + ", ".join(
    f"coalesce((page_location='{p[5:].upper()}')::INTEGER, 0) AS {p}" for p in PAGES) + " FROM gpanel")
def _(spark, d):
    return K.one_hot_page(gpanel(spark, d)).select("group_code", "yr_wk", *PAGES)


@query("one_hot_page_kept", "SELECT group_code, yr_wk, " + ", ".join(
    f"coalesce((page_location='{p[5:].upper()}')::INTEGER, 0) AS {p}" for p in PAGES) + " FROM gpanel")
def _(spark, d):
    once = K.one_hot_page(gpanel(spark, d))
    return K.one_hot_page(once).select("group_code", "yr_wk", *PAGES)


@query("zero_fill", """SELECT upc, store, yr_wk, coalesce(retail_price, 0)::DOUBLE AS retail_price,
  coalesce(cpp, 0)::INTEGER AS cpp FROM panel""")
def _(spark, d):
    return K.zero_fill(panel(spark, d).select("upc", "store", "yr_wk", "retail_price", "cpp"))


@query("default_region", "SELECT group_code, yr_wk, 'NATIONAL' AS region FROM gpanel")
def _(spark, d):
    return K.default_region(gpanel(spark, d)).select("group_code", "yr_wk", "region")


@query("page_location_text", "SELECT o_orderkey, (o_orderkey % 4)::VARCHAR AS page_location FROM orders")
def _(spark, d):
    rows = tables.read_table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("page_location"))
    return K.page_location_text(rows)


@query("group_constant", "SELECT group_code, yr_wk, dept, 'NATIONAL' AS region FROM hdense")
def _(spark, d):
    rows = K.default_region(history_panel(spark, d))
    return X.densify(rows, history_calendar(spark, d), ("dept", "region")).select(
        "group_code", "yr_wk", "dept", "region")


@query("has_promo", f"SELECT group_code, yr_wk, {ANY_PROMO}::INTEGER AS has_promo FROM hclean")
def _(spark, d):
    return hclean(spark, d).select("group_code", "yr_wk", K.has_promo().cast("int").alias("has_promo"))


@query("drop_head", f"""SELECT group_code, yr_wk, qty FROM
  (SELECT *, row_number() OVER {W} AS rn FROM gpanel) WHERE rn > 4""")
def _(spark, d):
    return X.drop_head(gpanel(spark, d)).select("group_code", "yr_wk", "qty")


LONG_LAGS = " UNION ALL ".join(
    f"SELECT dept, group_code, yr_wk, '{c}' AS lag, coalesce({c},0)::DOUBLE AS value FROM hlags" for c in LAG_COLUMNS)


@query("drop_constant_features", "SELECT dept, group_code, yr_wk, lag, " + rnd("value") + """ FROM (SELECT *,
  min(value) OVER g AS lo, max(value) OVER g AS hi FROM longlags WINDOW g AS (PARTITION BY group_code, lag)) WHERE lo < hi""", longlags=LONG_LAGS)
def _(spark, d):
    return r6(X.drop_constant_features(X.lags_long(X.promo_lags(hclean(spark, d)))))


@query("select_family", "SELECT group_code, yr_wk, " + ", ".join(
    f"cpp_flag_lag_{k}" for k in LAGS) + " FROM hlags")
def _(spark, d):
    return K.select_family(X.promo_lags(hclean(spark, d)), r"cpp_.*_lag_\d", ("group_code", "yr_wk"))


@query("order_columns", "SELECT yr_wk, qty, group_code, dept FROM gpanel")
def _(spark, d):
    return K.order_columns(gpanel(spark, d), ["yr_wk", "qty", "group_code", "dept"])


@query("keep_lags", "SELECT dept, group_code, yr_wk, lag, " + rnd("value") + """
  FROM longlags WHERE (group_code, lag) IN (SELECT (focus_group, lag) FROM pf_edges)
    OR group_code NOT IN (SELECT focus_group FROM pf_edges)""", longlags=LONG_LAGS)
def _(spark, d):
    return r6(X.keep_lags(X.lags_long(X.promo_lags(hclean(spark, d))), retail.pull_forward_edges(spark, d)))


@query("on_promo_in_week", """SELECT DISTINCT dept, group_code FROM gpanel WHERE yr_wk = (SELECT w FROM wk_end)
  AND greatest(flyer_flag, cpp_flag, digest_flag, digital_flag) > 0""")
def _(spark, d):
    return K.on_promo_in_week(gpanel(spark, d), window(spark, d).end)


TWO_DEPTS = """SELECT * REPLACE (CASE WHEN yr_wk%2=0 AND regexp_extract(group_code,'(\\d+)$',1)::INTEGER%7=0
  THEN dept+10 ELSE dept END AS dept) FROM gpanel"""


@query("single_dept_only", "SELECT group_code FROM two GROUP BY 1 HAVING count(DISTINCT dept)=1", two=TWO_DEPTS)
def _(spark, d):
    number = F.regexp_extract("group_code", r"(\d+)$", 1).cast("int")
    rows = gpanel(spark, d).withColumn(
        "dept", F.when((F.col("yr_wk") % 2 == 0) & (number % 7 == 0), F.col("dept") + 10).otherwise(F.col("dept")))
    return X.single_dept_groups(rows)


@query("skip_empty", """SELECT group_code, count(*) AS n FROM hclean WHERE group_code IN
  (SELECT group_code FROM hclean GROUP BY 1 HAVING max(page_front*ar_depth*digest_flag*digital_flag)>0) GROUP BY 1""")
def _(spark, d):
    product = F.col("page_front") * F.col("ar_depth") * F.col("digest_flag") * F.col("digital_flag")
    return X.skip_empty(hclean(spark, d).withColumn("rare", product), "rare").groupBy("group_code").agg(
        F.count(F.lit(1)).alias("n"))


# --- joins ------------------------------------------------------------------------------

@query("lookup_group", """SELECT g.group_code, yr_wk, target_group, qty FROM gpanel g
  JOIN cann_edges e ON e.focus_group=g.group_code AND e.focus_dept=g.dept""")
def _(spark, d):
    e = retail.relation_edges(spark, d, "cann").select(
        F.col("focus_group").alias("group_code"), F.col("focus_dept").alias("dept"), "target_group")
    return gpanel(spark, d).join(e, ["group_code", "dept"]).select("group_code", "yr_wk", "target_group", "qty")


@query("densify", "SELECT dept, group_code, yr_wk, qty, sales, cpp_flag FROM hdense")
def _(spark, d):
    rows = X.densify(history_panel(spark, d), history_calendar(spark, d))
    return K.zero_fill(rows.select("dept", "group_code", "yr_wk", "qty", "sales", "cpp_flag"))


def _cross_sql(kind: str) -> str:
    value = "CASE promo " + " ".join(f"WHEN '{p}' THEN {p}::DOUBLE" for p in PROMOTIONS) + " END"
    return f"""SELECT target_group, yr_wk, focus_group || '_' || promo || '_{kind.upper()}_PROMO' AS feature,
  {value} AS value FROM (SELECT * EXCLUDE (promos), unnest(promos) AS promo FROM {kind}_edges) e
  JOIN hclean c ON c.group_code=e.focus_group
  WHERE target_group IN (SELECT group_code FROM hclean)"""


for _kind in ("cann", "halo"):
    @query(f"add_{_kind}_features", _cross_sql(_kind))
    def _(spark, d, kind=_kind):
        f = X.cross_features(sink.shared(hclean(spark, d)), retail.relation_edges(spark, d, kind), kind)
        return f.select("target_group", "yr_wk", "feature", "value")


@query("feature_matrix", """SELECT target_group, yr_wk,
  max(value) FILTER (feature='Brand#20_cpp_flag_CANN_PROMO') AS "Brand#20_cpp_flag_CANN_PROMO",
  max(value) FILTER (feature='Brand#20_tr_depth_CANN_PROMO') AS "Brand#20_tr_depth_CANN_PROMO",
  max(value) FILTER (feature='Brand#20_digest_flag_CANN_PROMO') AS "Brand#20_digest_flag_CANN_PROMO"
  FROM crossed WHERE target_group='Brand#25' GROUP BY 1, 2""", crossed=_cross_sql("cann"))
def _(spark, d):
    f = X.cross_features(sink.shared(hclean(spark, d)), retail.relation_edges(spark, d, "cann"), "cann")
    return X.feature_matrix(f, "Brand#25", [
        f"Brand#20_{p}_CANN_PROMO" for p in ("cpp_flag", "tr_depth", "digest_flag")])


@query("join_trend", "SELECT group_code, yr_wk, " + rnd("trend") + " FROM htrend")
def _(spark, d):
    return r6(table(spark, d).select("group_code", "yr_wk", "trend"))


@query("join_slot", "SELECT group_code, yr_wk, coalesce(slot, 0)::INTEGER AS slot FROM hslot")
def _(spark, d):
    return table(spark, d).select("group_code", "yr_wk", F.coalesce("slot", F.lit(0)).cast("int").alias("slot"))


INTEREST = """SELECT DISTINCT dept, group_code FROM (
  SELECT dept, group_code FROM gpanel WHERE yr_wk=(SELECT w FROM wk_end)
    AND greatest(flyer_flag, cpp_flag, digest_flag, digital_flag)>0
  UNION ALL SELECT dept, group_code FROM fpanel WHERE flyer_flag=1
  UNION ALL SELECT target_dept, target_group FROM halo_edges
  UNION ALL SELECT target_dept, target_group FROM cann_edges)"""


def interest(spark, d):
    w = window(spark, d)
    g = gpanel(spark, d)
    ahead = tables.future_targets(g, w.forecast_start, w.forecast_end)
    return G.groups_of_interest(
        K.on_promo_in_week(g, w.end), ahead,
        tables.scan_edges(retail.relation_edges(spark, d, "halo")), tables.scan_edges(retail.relation_edges(spark, d, "cann")))


@query("keep_groups", "SELECT group_code, yr_wk, qty FROM gpanel WHERE group_code IN (SELECT group_code FROM now_)",
       now_="""SELECT group_code FROM gpanel WHERE yr_wk=(SELECT w FROM wk_end)
         AND greatest(flyer_flag, cpp_flag, digest_flag, digital_flag)>0""")
def _(spark, d):
    g = gpanel(spark, d)
    return G.keep_groups(g, K.on_promo_in_week(g, window(spark, d).end)).select("group_code", "yr_wk", "qty")


@query("last_regular_block", "SELECT upc, store, block_id, ref_block FROM eref")
def _(spark, d):
    return E.last_regular_block(blocks(spark, d)).select(
        "upc", "store", "block_id", F.col("ref")["block_id"].alias("ref_block"))


@query("ref_elasticity", "SELECT upc, store, ref_block, " + rnd("e_ref") + " FROM elastref")
def _(spark, d):
    rows = E.with_multipliers(E.with_promo_elasticity(blocks(spark, d)))
    return r6(rows.filter(F.col("e_promo").isNotNull()).select(
        "upc", "store", F.col("ref")["block_id"].alias("ref_block"), "e_ref").distinct())


@query("prev_block", """SELECT upc, store, block_id, lag(promo_type) OVER w AS prev_type,
  """ + rnd("lag(price) OVER w AS prev_price") + """ FROM esmooth
  WINDOW w AS (PARTITION BY upc, store ORDER BY block_id)""")
def _(spark, d):
    rows = E.prev_block(blocks(spark, d))
    return r6(rows.select("upc", "store", "block_id", F.col("prev")["promo_type"].alias("prev_type"),
                          F.col("prev")["price"].alias("prev_price")))


@query("periodic_pairs", """SELECT m.group_code, m.t, EXISTS (SELECT 1 FROM marked o WHERE o.group_code=m.group_code
  AND abs(o.t-m.t)=52) AS paired FROM marked m""",
       marked="SELECT group_code, t FROM hslot WHERE cpp_flag=1 AND digital_flag=1")
def _(spark, d):
    rows = X.week_index(X.drop_head(hclean(spark, d))).withColumn(
        "mark", (F.col("cpp_flag") == 1) & (F.col("digital_flag") == 1))
    return L.periodic_pairs(rows, "mark").filter("mark").select("group_code", "t", "paired")


@query("distinct_keep_first", """SELECT p_brand, p_size, p_partkey, p_type FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey, p_type)=1""")
def _(spark, d):
    rows = tables.read_table(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_type")
    return G.distinct_keep_first(rows, "p_brand", "p_size")


# --- aggregations ---------------------------------------------------------------------------

@query("profile_by_upc", """SELECT upc, count(DISTINCT yr_wk) AS n_weeks, count(DISTINCT store) AS n_stores,
  count(*) AS n_rows FROM panel GROUP BY 1""")
def _(spark, d):
    return S.profile_by_upc(panel(spark, d))


@query("row_counts", """SELECT count(*) AS rows_before, count(*) FILTER (retail_price IS NOT NULL
  AND net_units>=0 AND net_sales>=0) AS rows_after FROM panel""")
def _(spark, d):
    ok = F.col("retail_price").isNotNull() & (F.col("net_units") >= 0) & (F.col("net_sales") >= 0)
    return S.row_counts(panel(spark, d), ok)


@query("counted_cleaning", """SELECT count(*) AS rows_before, count(*) FILTER (retail_price IS NOT NULL
  AND net_units>=0 AND net_sales>=0) AS rows_after FROM panel""")
def _(spark, d):
    ok = F.col("retail_price").isNotNull() & (F.col("net_units") >= 0) & (F.col("net_sales") >= 0)
    clean, seen = S.counted_cleaning(panel(spark, d), ok)
    sink.write_frame(clean, f"{sink.shared_dir(spark)}/clean-{uuid.uuid4().hex}", ())
    # the run that wrote the clean rows counted them
    return spark.createDataFrame([(seen.get["rows_before"], seen.get["rows_after"])], "rows_before long, rows_after long")


@query("iqr_bounds", "SELECT upc, store, block_id, " + rnd("lo", "hi") + " FROM ebounds")
def _(spark, d):
    rows = E.iqr_bounds(E.with_blocks(E.clean_series(panel(spark, d))))
    return r6(rows.select("upc", "store", "block_id", "lo", "hi").distinct())


@query("block_stats", "SELECT upc, store, block_id, " + rnd("avg_units", "avg_retail") + ", kept_weeks, weeks FROM estats")
def _(spark, d):
    rows = E.block_stats(E.with_blocks(E.clean_series(panel(spark, d))))
    return r6(rows.select("upc", "store", "block_id", "avg_units", "avg_retail", "kept_weeks", "weeks"))


@query("block_summary", "SELECT upc, store, block_id, promo_type, start_wk, end_wk, " + rnd("regular_price") + " FROM estats")
def _(spark, d):
    rows = E.block_stats(E.with_blocks(E.clean_series(panel(spark, d))))
    return r6(rows.select("upc", "store", "block_id", "promo_type", "start_wk", "end_wk", "regular_price"))


@query("robust_center", "SELECT group_code, " + rnd("center", "1.5*mad AS spread") + " FROM hcenter")
def _(spark, d):
    rows = full_detrended(spark, d)
    return r6(T.robust_center(rows, "detrended", K.has_promo(), 1.5)
              .select("group_code", "center", "spread").distinct())


def unrepaired(spark, d):
    return table(spark, d, ModelParams())


def full_detrended(spark, d):
    return unrepaired(spark, d).withColumn("detrended", F.col("modelled_qty") - F.col("trend"))


@query("first_sale", "SELECT group_code, first_t::INTEGER AS first_t FROM hfirst")
def _(spark, d):
    rows = T.first_sale(X.drop_head(hclean(spark, d)))
    return rows.select("group_code", "first_t").distinct()


@query("linear_trend", "SELECT group_code, yr_wk, t, " + rnd("trend") + " FROM htrend")
def _(spark, d):
    rows = T.linear_trend(X.drop_head(hclean(spark, d)))
    return r6(rows.select("group_code", "yr_wk", "t", "trend"))


FIT = rnd("coalesce(avg(abs(fitted-modelled_qty)/modelled_qty) FILTER (modelled_qty>0),0) AS mape",
          "sqrt(avg(pow(fitted-modelled_qty,2))) AS rmse")


@query("fit_metrics", f"SELECT dept, group_code, {FIT} FROM base GROUP BY ALL")
def _(spark, d):
    return r6(B.fit_metrics(results(spark, d)))


@query("baseline_level", "SELECT dept, group_code, " + rnd("level") + " FROM levels_")
def _(spark, d):
    return r6(FC.baseline_level(results(spark, d)))


@query("promo_impact", "SELECT dept, group_code, " + rnd(*[f"{p}_impact" for p in PROMOS]) + " FROM levels_")
def _(spark, d):
    return r6(FC.promo_impact(results(spark, d)))


@query("mean_price", "SELECT dept, group_code, " + rnd("price") + " FROM levels_")
def _(spark, d):
    return r6(FC.mean_price(results(spark, d)))


EFFECT = " UNION ALL ".join(f"""SELECT dept, group_code, '{p}' AS promo,
  count(*) FILTER ({p}>0) AS weeks_on, count(*) FILTER ({p}=0) AS weeks_off,
  avg(lift_share) FILTER ({p}>0) AS avg_lift,
  avg(qty) FILTER ({p}>0) AS qty_on, avg(qty) FILTER ({p}=0) AS qty_off,
  avg(sales) FILTER ({p}>0) AS sales_on, avg(sales) FILTER ({p}=0) AS sales_off
  FROM results GROUP BY 1, 2""" for p in PROMOS)


@query("promo_effectiveness", "SELECT dept, group_code, promo, weeks_on, weeks_off, " + rnd(
    "avg_lift", "qty_on", "qty_off", "sales_on", "sales_off",
    "CASE WHEN sales_off>0 THEN (sales_on-sales_off)/sales_off ELSE 0 END AS roi", digits=4)
    + " FROM effect WHERE weeks_on>0 AND weeks_off>0", effect=EFFECT)
def _(spark, d):
    return r6(I.promo_effectiveness(results(spark, d)), 4)


RECENT = """SELECT dept, group_code, avg(qty) AS recent_qty FROM
  (SELECT *, row_number() OVER (PARTITION BY group_code ORDER BY yr_wk DESC) AS rn FROM results)
  WHERE rn<=12 GROUP BY 1, 2"""
TREND = """SELECT dept, group_code, recent_qty, forecast_qty,
  CASE WHEN recent_qty>0 THEN (forecast_qty-recent_qty)/recent_qty ELSE 0 END AS pct_change
  FROM recent_ JOIN (SELECT group_code, avg(qty) AS forecast_qty FROM ahead GROUP BY 1) USING (group_code)"""


@query("forecast_vs_recent", "SELECT dept, group_code, " + rnd("recent_qty", "forecast_qty", "pct_change")
       + " FROM trending", recent_=RECENT, trending=TREND)
def _(spark, d):
    return r6(I.forecast_vs_recent(*results_and_plan(spark, d)))


LAG_CORR = """SELECT dept, group_code, lag, corr(resid, value) AS r FROM (
  SELECT l.dept, l.group_code, l.lag, l.value, s.resid FROM longlags l JOIN seasoned s USING (group_code, yr_wk))
  GROUP BY 1, 2, 3 HAVING min(value)<max(value)"""
SEASONED = """SELECT group_code, yr_wk, up - avg(up) OVER (PARTITION BY group_code, slot) AS resid FROM
  (SELECT group_code, yr_wk, slot, greatest(modelled_qty-trend, 0) AS up FROM table_full)"""
# the table with all lags: same rows and quantities, every lag kept
TABLE_FULL = """SELECT t.* EXCLUDE (""" + ", ".join(LAG_COLUMNS) + "), " + ", ".join(
    f"l.{c}" for c in LAG_COLUMNS) + " FROM table_ t JOIN hlags l USING (group_code, yr_wk)"
LONG_KEPT = " UNION ALL ".join(
    f"SELECT dept, group_code, yr_wk, '{c}' AS lag, coalesce({c},0)::DOUBLE AS value FROM table_full"
    for c in LAG_COLUMNS)


@query("lag_correlation", "SELECT dept, group_code, lag, " + rnd("r") + " FROM corr_",
       corr_=LAG_CORR, seasoned=SEASONED, table_full=TABLE_FULL, longlags=LONG_KEPT)
def _(spark, d):
    rows = P.detrended_quantity(full_lag_table(spark, d))
    return r6(P.lag_correlation(T.seasonal_adjust(rows, "above_trend", "residual"), "residual"))


@query("negative_lags", """SELECT group_code AS focus_group, -0.000001::DOUBLE AS correlation_level,
  string_agg('''' || lag || '''', ', ' ORDER BY lag) AS pf_promotions, dept AS focus_dept
  FROM corr_ WHERE r <= -0.000001 GROUP BY group_code, dept""",
       corr_=LAG_CORR, seasoned=SEASONED, table_full=TABLE_FULL, longlags=LONG_KEPT)
def _(spark, d):
    rows = P.detrended_quantity(full_lag_table(spark, d))
    return P.negative_lags(P.lag_correlation(T.seasonal_adjust(rows, "above_trend", "residual"), "residual"))


def _eta_sql(num: str, cat: str) -> str:
    return f"""SELECT '{num}' AS "left", '{cat}' AS "right", 'correlation_ratio' AS kind,
  sqrt(sum(n*(m-g)*(m-g))/any_value(sst)) AS value FROM (
  SELECT {cat}, count({num}) AS n, avg({num}) AS m, any_value(g) AS g, any_value(sst) AS sst FROM li,
    (SELECT avg({num}) AS g, var_pop({num})*count({num}) AS sst FROM li) GROUP BY 1)"""


def _cramer_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", 'cramers_v' AS kind,
  sqrt(chi2/n/(least(ka,kb)-1)) AS value FROM (
  SELECT sum(pow(coalesce(o,0)-ra*cb/n,2)/(ra*cb/n)) AS chi2, any_value(n) AS n,
    count(DISTINCT x) AS ka, count(DISTINCT y) AS kb FROM
  (SELECT {a} AS x, count(*)::DOUBLE AS ra FROM li GROUP BY 1) CROSS JOIN
  (SELECT {b} AS y, count(*)::DOUBLE AS cb FROM li GROUP BY 1) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM li)
  LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS o FROM li GROUP BY 1, 2) USING (x, y))"""


_NUM = ("l_quantity", "l_extendedprice", "l_discount")
_CAT = ("l_returnflag", "l_linestatus", "p_brand")
_PARTS = [f"""SELECT '{a}' AS "left", '{b}' AS "right", 'pearson' AS kind, corr({a},{b}) AS value FROM li"""
          for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
_PARTS += [_eta_sql(n, c) for c in _CAT for n in _NUM]
_PARTS += [_cramer_sql(a, b) for i, a in enumerate(_CAT) for b in _CAT[i + 1:]]


@query("association_matrix", 'SELECT "left", "right", kind, ' + rnd("value") + " FROM assoc",
       li="SELECT * FROM lineitem JOIN part ON l_partkey=p_partkey", assoc=" UNION ALL ".join(_PARTS))
def _(spark, d):
    parts = tables.read_table(spark, d, "part").select("p_partkey", "p_brand")
    rows = tables.read_table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return r6(S.association_matrix(rows.select(*_NUM, *_CAT), _NUM, _CAT))


INSIGHT_SQL = """
SELECT group_code, dept, 'PROMO_EFFECTIVENESS' AS insight_type, promo AS promo_type, 'LIFT_PCT' AS metric,
  avg_lift AS value, CASE WHEN CASE WHEN sales_off>0 THEN (sales_on-sales_off)/sales_off ELSE 0 END>0.2
    THEN 'Promote more often' WHEN CASE WHEN sales_off>0 THEN (sales_on-sales_off)/sales_off ELSE 0 END>0
    THEN 'Keep promoting as often' ELSE 'Promote less often' END AS recommendation
  FROM effect WHERE weeks_on>0 AND weeks_off>0
UNION ALL SELECT group_code, dept, 'BEST_WEEK', 'ALL', 'QTY', qty, 'Plan these promotions again: ' || active FROM best_
UNION ALL SELECT group_code, dept, 'WORST_WEEK', 'ALL', 'QTY', qty, 'Plan without these promotions: ' || active FROM worst_
UNION ALL SELECT group_code, dept, 'FORECAST_TREND', 'ALL', 'QTY', pct_change,
  CASE WHEN pct_change<0 THEN 'Look for promotions that lift the coming weeks' ELSE 'Keep the planned promotions' END FROM trending
UNION ALL SELECT group_code, dept, 'FORECAST_BEST_WEEK', 'ALL', 'QTY', qty,
  'Stock up ahead of week ' || yr_wk::VARCHAR FROM bestf"""
BEST = f"""SELECT dept, group_code, yr_wk, qty, {ACTIVE} AS active FROM results
  QUALIFY row_number() OVER (PARTITION BY group_code ORDER BY qty DESC, yr_wk)=1"""
WORST = f"""SELECT dept, group_code, yr_wk, qty, {ACTIVE} AS active FROM results WHERE qty>0
  QUALIFY row_number() OVER (PARTITION BY group_code ORDER BY qty, yr_wk)=1"""
BESTF = f"""SELECT dept, group_code, yr_wk, qty, {ACTIVE} AS active FROM ahead
  QUALIFY row_number() OVER (PARTITION BY group_code ORDER BY round(qty,6) DESC, yr_wk)=1"""
INSIGHT_CTES = dict(effect=EFFECT, best_=BEST, worst_=WORST, bestf=BESTF, recent_=RECENT, trending=TREND)


@query("insights", "SELECT group_code, dept, insight_type, promo_type, metric, " + rnd("value")
       + ", recommendation FROM found", found=INSIGHT_SQL, **INSIGHT_CTES)
def _(spark, d):
    r, ahead = results_and_plan(spark, d)
    return r6(I.insights(r, ahead.withColumn("qty", F.round("qty", 6))).drop("analysis"))


def _pct(x: str) -> str:
    return f"printf('%.1f%%', round(100*({x}), 1))"


TEXT_SQL = f"""
SELECT group_code, dept, 'PROMO_EFFECTIVENESS' AS insight_type, promo AS promo_type,
  'Mean lift over baseline: ' || {_pct('avg_lift')} || ' in weeks with ' || promo AS analysis
  FROM effect WHERE weeks_on>0 AND weeks_off>0
UNION ALL SELECT group_code, dept, 'BEST_WEEK', 'ALL',
  'Best week: ' || yr_wk || ', ' || printf('%.0f', round(qty)) || ' units' FROM best_
UNION ALL SELECT group_code, dept, 'WORST_WEEK', 'ALL',
  'Worst week: ' || yr_wk || ', ' || printf('%.0f', round(qty)) || ' units' FROM worst_
UNION ALL SELECT group_code, dept, 'FORECAST_TREND', 'ALL', 'Expected quantity goes ' ||
  CASE WHEN forecast_qty>recent_qty THEN 'up' ELSE 'down' END || ' by ' || {_pct('abs(pct_change)')}
  || ' against the last weeks'' mean' FROM trending
UNION ALL SELECT group_code, dept, 'FORECAST_BEST_WEEK', 'ALL', 'Largest expected quantity: week ' || yr_wk
  || ', about ' || printf('%.0f', round(qty)) || ' units' FROM bestf"""


@query("insight_texts", TEXT_SQL, **INSIGHT_CTES)
def _(spark, d):
    r, ahead = results_and_plan(spark, d)
    return I.insights(r, ahead.withColumn("qty", F.round("qty", 6))).select(
        "group_code", "dept", "insight_type", "promo_type", "analysis")


@query("scoreboard", """SELECT dept, sum(result)::BIGINT AS result_rows, count(DISTINCT group_code) FILTER (result>0) AS groups,
  sum(fc)::BIGINT AS forecast_rows, sum(ins)::BIGINT AS insight_rows FROM (
  SELECT dept, group_code, count(*) FILTER (k='r') AS result, count(*) FILTER (k='f') AS fc, count(*) FILTER (k='i') AS ins
  FROM (SELECT dept, group_code, 'r' AS k FROM results UNION ALL SELECT dept, group_code, 'f' FROM ahead
    UNION ALL SELECT dept, group_code, 'i' FROM found) GROUP BY 1, 2) GROUP BY ROLLUP (dept)""",
       found=INSIGHT_SQL, **INSIGHT_CTES)
def _(spark, d):
    r, ahead = results_and_plan(spark, d)
    return S.scoreboard(r, ahead, I.insights(r, ahead))


@query("quoted_list", """SELECT p_brand, string_agg('''' || p_type || '''', ', ' ORDER BY p_type) AS types
  FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1""")
def _(spark, d):
    rows = tables.read_table(spark, d, "part").select("p_brand", "p_type").distinct()
    return rows.groupBy("p_brand").agg(quoted_list(F.collect_list("p_type")).alias("types"))


@query("partition_skew")
def _(spark, d):
    rows = gpanel(spark, d).repartition(8, "group_code", "yr_wk")
    return S.partition_skew(rows, 8)


@query("mode_nonzero", """SELECT upc, store, coalesce(v, 0) AS mode_value FROM (SELECT DISTINCT upc, store FROM panel)
  LEFT JOIN (SELECT upc, store, retail_price AS v FROM panel WHERE retail_price<>0 GROUP BY upc, store, retail_price
    QUALIFY row_number() OVER (PARTITION BY upc, store ORDER BY count(*) DESC, v)=1) USING (upc, store)""")
def _(spark, d):
    return S.mode_nonzero(panel(spark, d), ("upc", "store"), "retail_price")


YEAR_LEVELS = """SELECT group_code, yr_wk, (t//60+1)::INTEGER AS level, t, modelled_qty FROM hslot"""


def year_levels(spark, d):
    """The history in fixed stretches of 60 weeks."""
    rows = X.week_index(X.drop_head(hclean(spark, d)))
    return rows.select("group_code", "yr_wk", (F.floor(F.col("t") / 60) + 1).cast("int").alias("level"),
                       "t", "modelled_qty")


@query("mann_kendall", """SELECT group_code, level, n::INTEGER AS n, s, """ + rnd(
    "s/sqrt((n*(n-1)/2)*(n*(n-1)/2-tp/2)) AS tau", "p AS p_value") + """ FROM mkz JOIN ntail USING (z)""", lv=YEAR_LEVELS,
       # P(|Z| >= z) by Simpson's rule over the normal density
       ntail="""SELECT z, greatest(1-2*sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END * abs(z)/6000
         * exp(-pow(z*i/2000.0, 2)/2)/sqrt(2*pi())), 0) AS p FROM (SELECT DISTINCT z FROM mkz), (SELECT unnest(range(2001)) AS i) GROUP BY z""",
       mkz="""SELECT *, (s-sign(s))/nullif(sqrt((n*(n-1)*(2*n+5)-tv)/18), 0) AS z FROM (
  SELECT a.group_code, a.level, sum(sign(b.modelled_qty-a.modelled_qty))::DOUBLE AS s FROM lv a JOIN lv b
    ON a.group_code=b.group_code AND a.level=b.level AND a.t<b.t GROUP BY 1, 2)
  JOIN (SELECT group_code, level, sum(c)::DOUBLE AS n, sum(c*(c-1))::DOUBLE AS tp, sum(c*(c-1)*(2*c+5))::DOUBLE AS tv FROM
    (SELECT group_code, level, modelled_qty, count(*) AS c FROM lv GROUP BY 1, 2, 3) GROUP BY 1, 2)
  USING (group_code, level)""")
def _(spark, d):
    return r6(L.mann_kendall(year_levels(spark, d), "modelled_qty"))


@query("active_promos", f"SELECT group_code, yr_wk, {ACTIVE} AS active FROM hclean")
def _(spark, d):
    return hclean(spark, d).select("group_code", "yr_wk", active_promos(PROMOS).alias("active"))


# --- windows ------------------------------------------------------------------------------------

@query("promo_lags", "SELECT group_code, yr_wk, " + ", ".join(LAG_COLUMNS) + " FROM hlags")
def _(spark, d):
    return X.promo_lags(hclean(spark, d)).select("group_code", "yr_wk", *LAG_COLUMNS)


@query("change_flag", "SELECT upc, store, yr_wk, changed FROM eblocks")
def _(spark, d):
    return E.change_flag(E.clean_series(panel(spark, d))).select("upc", "store", "yr_wk", "changed")


@query("block_id", "SELECT upc, store, yr_wk, promo_type, block_id FROM eblocks")
def _(spark, d):
    return E.with_blocks(E.clean_series(panel(spark, d))).select("upc", "store", "yr_wk", "promo_type", "block_id")


@query("week_index", f"SELECT group_code, yr_wk, (row_number() OVER {W})::INTEGER AS t FROM gpanel")
def _(spark, d):
    return X.week_index(gpanel(spark, d)).select("group_code", "yr_wk", "t")


@query("fill_price_avg", "SELECT group_code, yr_wk, " + rnd("regular_price", "live_price") + " FROM hclean")
def _(spark, d):
    return r6(hclean(spark, d).select("group_code", "yr_wk", "regular_price", "live_price"))


MODE_SQL = """SELECT group_code, yr_wk, CASE WHEN live_price<>0 THEN live_price ELSE coalesce((
  SELECT v.live_price FROM numbered v WHERE v.group_code=n.group_code AND abs(v.rn-n.rn)<=4 AND v.live_price<>0
  GROUP BY v.live_price ORDER BY count(*) DESC, v.live_price LIMIT 1), 0) END AS live_price FROM numbered n"""


@query("fill_price_mode", MODE_SQL, numbered=f"SELECT group_code, yr_wk, live_price, row_number() OVER {W} AS rn FROM hdense")
def _(spark, d):
    return hclean(spark, d, params=ModelParams(price_fill="mode")).select("group_code", "yr_wk", "live_price")


# the last four filled prices travel along the weeks of a group
@query("fill_price_mode_recursive", "SELECT group_code, yr_wk, live_price FROM walked WHERE rn>0",
       numbered=f"SELECT group_code, yr_wk, live_price, row_number() OVER {W} AS rn FROM hdense",
       windowed="""SELECT a.group_code, a.yr_wk, a.rn, a.live_price,
           coalesce(list(b.live_price) FILTER (b.live_price<>0), []::DOUBLE[]) AS right_
         FROM numbered a LEFT JOIN numbered b ON b.group_code=a.group_code AND b.rn BETWEEN a.rn+1 AND a.rn+4
         GROUP BY a.group_code, a.yr_wk, a.rn, a.live_price""",
       walked="""SELECT DISTINCT group_code, 0 AS yr_wk, 0::BIGINT AS rn, 0.0::DOUBLE AS live_price, []::DOUBLE[] AS done
           FROM numbered
         UNION ALL SELECT group_code, yr_wk, rn, price, done[-3:] || [price] FROM (
           SELECT w.group_code, w.yr_wk, w.rn, p.done, CASE WHEN w.live_price<>0 THEN w.live_price ELSE coalesce((
             SELECT v FROM (SELECT unnest(p.done || w.right_) AS v) WHERE v<>0
             GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), 0) END AS price
           FROM walked p JOIN windowed w ON w.group_code=p.group_code AND w.rn=p.rn+1)""")
def _(spark, d):
    rows = K.zero_fill(X.densify(history_panel(spark, d), history_calendar(spark, d)))
    return X.fill_price_mode(rows, ("live_price",), recursive=True).select("group_code", "yr_wk", "live_price")


@query("week_slot", "SELECT group_code, yr_wk, slot FROM hslot")
def _(spark, d):
    return X.week_slot(X.drop_head(hclean(spark, d))).select("group_code", "yr_wk", F.col("slot").cast("int").alias("slot"))


@query("slot_dummies", "SELECT group_code, yr_wk, " + ", ".join(
    f"(slot={i})::INTEGER AS week_{i}" for i in range(1, SLOTS + 1)) + " FROM hslot")
def _(spark, d):
    rows = X.slot_dummies(X.week_slot(X.drop_head(hclean(spark, d))))
    return rows.select("group_code", "yr_wk", *[f"week_{i}" for i in range(1, SLOTS + 1)])


@query("smooth_regular_price", "SELECT upc, store, block_id, " + rnd("price", "avg_price") + ", spiked FROM esmooth")
def _(spark, d):
    return r6(blocks(spark, d).select("upc", "store", "block_id", "price", "avg_price", "spiked"))


@query("seasonal_adjust", "SELECT group_code, yr_wk, " + rnd(
    "modelled_qty - avg(modelled_qty) OVER (PARTITION BY group_code, slot) AS adjusted") + " FROM hslot")
def _(spark, d):
    rows = X.week_slot(X.drop_head(hclean(spark, d)))
    return r6(T.seasonal_adjust(rows, "modelled_qty", "adjusted").select("group_code", "yr_wk", "adjusted"))


LEVEL_CTES = dict(
    lv=YEAR_LEVELS,
    runs="""SELECT *, (row_number() OVER (PARTITION BY group_code, level ORDER BY t)-1)//14 AS run FROM lv""",
    wmed="""SELECT r.*, m.window_median, modelled_qty-m.window_median AS dev FROM runs r JOIN
      (SELECT group_code, level, run, median(modelled_qty) AS window_median FROM runs GROUP BY 1,2,3) m
      USING (group_code, level, run)""",
    lcent="""SELECT w.*, m AS center, mad(dev) OVER (PARTITION BY group_code, level) AS mad FROM wmed w JOIN
      (SELECT group_code, level, median(dev) AS m FROM wmed GROUP BY 1, 2) USING (group_code, level)""",
    lout="SELECT *, abs(dev-center) > 0.1*1.4*mad AS outlier FROM lcent",
    lpair="""SELECT o.*, outlier AND EXISTS (SELECT 1 FROM lout p WHERE p.group_code=o.group_code
      AND p.outlier AND abs(p.t-o.t)=52) AS paired FROM lout o""")


@query("window_medians", "SELECT group_code, t, " + rnd("window_median") + " FROM wmed", **LEVEL_CTES)
def _(spark, d):
    return r6(L.window_medians(year_levels(spark, d), "modelled_qty").select("group_code", "t", "window_median"))


def deviations(spark, d):
    rows = L.window_medians(year_levels(spark, d), "modelled_qty")
    return rows.withColumn("dev", F.col("modelled_qty") - F.col("window_median"))


@query("level_mad_outliers", "SELECT group_code, t, " + rnd("center", "mad") + ", outlier FROM lout", **LEVEL_CTES)
def _(spark, d):
    return r6(L.level_mad_outliers(deviations(spark, d), "dev").select("group_code", "t", "center", "mad", "outlier"))


@query("winsorize_outliers", "SELECT group_code, t, paired, " + rnd("""CASE WHEN outlier AND NOT paired THEN
  CASE WHEN dev>0 THEN center+0.1*1.3*mad ELSE center-0.1*1.3*mad END ELSE dev END AS winsorized""")
       + " FROM lpair", **LEVEL_CTES)
def _(spark, d):
    rows = L.winsorize_outliers(L.level_mad_outliers(deviations(spark, d), "dev"), "dev")
    return r6(rows.select("group_code", "t", "paired", "winsorized"))


LABELLED = """SELECT upc, store, metric || CASE WHEN count(*) OVER (PARTITION BY upc, store, metric)>1 THEN '_' ||
  row_number() OVER (PARTITION BY upc, store, metric ORDER BY block_id) ELSE '' END AS key,
  value, weeks::INTEGER AS weeks FROM emetrics"""


@query("metric_label", "SELECT upc, store, key, weeks FROM labelled", labelled=LABELLED)
def _(spark, d):
    return E.elasticity_metrics(panel(spark, d)).select("upc", "store", "key", "weeks")


# --- sorts, limits ----------------------------------------------------------------------------------

@query("order_panel", "SELECT group_code, yr_wk, qty FROM gpanel ORDER BY group_code, yr_wk")
def _(spark, d):
    return gpanel(spark, d).select("group_code", "yr_wk", "qty").orderBy("group_code", "yr_wk")


@query("best_week", "SELECT dept, group_code, yr_wk, qty, active FROM best_", best_=BEST)
def _(spark, d):
    return I.best_week(results(spark, d))


@query("worst_week", "SELECT dept, group_code, yr_wk, qty, active FROM worst_", worst_=WORST)
def _(spark, d):
    return I.worst_week(results(spark, d))


@query("forecast_best_week", "SELECT dept, group_code, yr_wk, " + rnd("qty") + ", active FROM bestf", bestf=BESTF)
def _(spark, d):
    return r6(I.best_week(planned(spark, d).withColumn("qty", F.round("qty", 6))))


@query("last_n_weeks", f"""SELECT group_code, yr_wk, qty FROM gpanel
  QUALIFY row_number() OVER (PARTITION BY group_code ORDER BY yr_wk DESC)<=12""")
def _(spark, d):
    return G.last_n_weeks(gpanel(spark, d), 12).select("group_code", "yr_wk", "qty")


@query("sample_groups", """SELECT dept, group_code FROM (SELECT DISTINCT dept, group_code FROM gpanel)
  QUALIFY row_number() OVER (PARTITION BY dept ORDER BY group_code)<=3""")
def _(spark, d):
    return G.sample_groups(gpanel(spark, d), 3)


@query("interest_or_sample", """SELECT dept, group_code FROM int1 UNION ALL
  SELECT dept, group_code FROM (SELECT DISTINCT dept, group_code FROM gpanel)
  WHERE dept NOT IN (SELECT dept FROM int1)
  QUALIFY row_number() OVER (PARTITION BY dept ORDER BY group_code)<=5""",
       int1="SELECT DISTINCT dept, group_code FROM gpanel WHERE page_front_=1 AND digest_flag=1 AND cpp_flag=1 AND tr_depth>0".replace(
           "page_front_=1", "page_location='FRONT'"))
def _(spark, d):
    # rare promotions, so that some departments have none
    g = gpanel(spark, d)
    chosen = g.filter((F.col("page_location") == "FRONT") & (F.col("digest_flag") == 1) & (F.col("cpp_flag") == 1) & (F.col("tr_depth") > 0))
    return G.interest_or_sample(chosen.select("dept", "group_code").distinct(), g)


@query("metric_order", """SELECT upc, store, key, CASE WHEN key LIKE 'E_regular%' THEN 1 WHEN key LIKE 'E_promo%' THEN 2
  WHEN key LIKE 'M_instore_flyer_cpp%' THEN 5 WHEN key LIKE 'M_instore_flyer%' THEN 3 ELSE 4 END AS kind_rank,
  coalesce(try_cast(nullif(regexp_extract(key, '_(\\d+)$', 1), '') AS INTEGER), 0) AS number FROM labelled""",
       labelled=LABELLED)
def _(spark, d):
    return E.metric_order(E.elasticity_metrics(panel(spark, d))).select("upc", "store", "key", "kind_rank", "number")


# --- set operations --------------------------------------------------------------------------------------

@query("groups_of_interest", INTEREST)
def _(spark, d):
    return interest(spark, d)


@query("union_frames", """SELECT dept, group_code, yr_wk, qty, regular_price FROM hpanel
  UNION ALL SELECT dept, group_code, yr_wk, NULL, regular_price FROM fpanel""")
def _(spark, d):
    first = history_panel(spark, d).select("dept", "group_code", "yr_wk", "qty", "regular_price")
    return G.union_frames(first, future_panel(spark, d).drop("qty"))


@query("bind_rows", """SELECT dept, group_code, yr_wk, NULL AS focus_group, NULL AS promo, 'halo' AS kind FROM hpanel
  UNION ALL SELECT dept, group_code, yr_wk, NULL, NULL, 'cann' FROM hpanel
  UNION ALL SELECT target_dept, target_group, NULL, focus_group, unnest(promos), 'halo' FROM halo_edges
  UNION ALL SELECT target_dept, target_group, NULL, focus_group, unnest(promos), 'cann' FROM cann_edges""")
def _(spark, d):
    related = [tables.scan_edges(e).select(F.col("target_dept").alias("dept"), F.col("target_group").alias("group_code"), F.lit(None).cast("int").alias("yr_wk"),
                                           "focus_group", F.explode("promos").alias("promo"), F.lit(k).alias("kind")) for k, e in both_edges(spark, d).items()]
    weekly = history_panel(spark, d).select("dept", "group_code", "yr_wk")
    return G.union_frames(*related, *[weekly.withColumn("kind", F.lit(k)) for k in ("halo", "cann")])


# --- scalar functions ---------------------------------------------------------------------------------------

@query("safe_log", "SELECT upc, store, yr_wk, " + rnd(
    "ln(greatest(net_units,1e-9)/greatest(units,1e-9)) AS units_log",
    "CASE WHEN retail_price IS NOT NULL THEN ln(greatest(retail_price,1e-9)/greatest(regular_price,1e-9)) END AS price_log")
    + " FROM panel")
def _(spark, d):
    return r6(panel(spark, d).select(
        "upc", "store", "yr_wk", safe_log(F.col("net_units"), F.col("units")).alias("units_log"),
        safe_log(F.col("retail_price"), F.col("regular_price")).alias("price_log")))


@query("round_metrics", "SELECT p_partkey, round(p_retailprice/7, 2) AS price FROM part")
def _(spark, d):
    return tables.read_table(spark, d, "part").select("p_partkey", metric_round(F.col("p_retailprice") / 7).alias("price"))


@query("multiplier", """SELECT upc, store, yr_wk, """ + rnd(
    "greatest(1.0, (units/10)/pow(retail_price/regular_price, -2.5)) AS m") + " FROM panel WHERE retail_price IS NOT NULL")
def _(spark, d):
    rows = panel(spark, d).filter(F.col("retail_price").isNotNull())
    return r6(rows.select("upc", "store", "yr_wk", multiplier(
        F.col("units") / 10, F.col("retail_price") / F.col("regular_price"), F.lit(-2.5)).alias("m")))


@query("string_functions", """SELECT DISTINCT upper(replace(p_brand,'#','_')) AS brand,
  concat(trim('  ' || p_type || ' '), '_lag_', p_size::VARCHAR) AS feature,
  regexp_replace(p_type, '[aeiou]', '', 'g') AS bare FROM part""")
def _(spark, d):
    part = tables.read_table(spark, d, "part")
    return part.select(
        F.upper(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"),
        F.concat(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))), F.lit("_lag_"), F.col("p_size").cast("string"))
        .alias("feature"),
        F.regexp_replace("p_type", "[aeiou]", "").alias("bare")).distinct()


@query("in_shock_weeks", "SELECT group_code, yr_wk FROM gpanel WHERE yr_wk IN (" + ",".join(map(str, SHOCK_WEEKS)) + ")")
def _(spark, d):
    return gpanel(spark, d).filter(in_weeks(F.col("yr_wk"), SHOCK_WEEKS)).select("group_code", "yr_wk")


@query("parse_quoted_list", """SELECT focus_group, unnest(promos) AS promo FROM halo_edges""")
def _(spark, d):
    return retail.relation_edges(spark, d, "halo").select(
        "focus_group", F.explode(parse_quoted_list(F.col("promos"))).alias("promo"))


def _side(price: str, weeks: str, units: str) -> str:
    def cents(x):
        return f"round(({x})::DECIMAL(18,6),2)::DOUBLE"
    return f"printf('P=%.2f(%dw)@U=%.2f', {cents(price)}, {weeks}, {cents(units)})"


@query("elasticity_detail", f"""SELECT m.upc, m.store, m.block_id, metric,
  'from ' || {_side('p.price', 'p.weeks', 'p.avg_units')} || ' to ' ||
  {_side("CASE WHEN metric='E_regular' THEN b.price ELSE b.avg_price END", 'b.weeks', 'b.avg_units')} AS detail
  FROM emetrics m JOIN esmooth b USING (upc, store, block_id) JOIN eref USING (upc, store, block_id)
  JOIN esmooth p ON p.upc=m.upc AND p.store=m.store
    AND p.block_id=CASE WHEN metric='E_regular' THEN m.block_id-1 ELSE eref.ref_block END""")
def _(spark, d):
    return E.block_metrics(blocks(spark, d)).select("upc", "store", "block_id", "metric", "detail")


@query("to_number", "SELECT event_id, try_cast(event_type AS DOUBLE) AS kind_number, " + rnd("value") + " FROM events")
def _(spark, d):
    ev = tables.read_table(spark, d, "events")
    return r6(ev.select("event_id", to_number(F.col("event_type")).alias("kind_number"),
                        to_number(F.col("value").cast("string")).alias("value")))


# --- plans -----------------------------------------------------------------------------------------------------

@query("regular_elasticity", "SELECT upc, store, block_id, " + rnd("value") + ", weeks::INTEGER AS weeks FROM ereg")
def _(spark, d):
    rows = E.with_regular_elasticity(blocks(spark, d)).filter(F.col("e_regular").isNotNull())
    return r6(rows.select("upc", "store", "block_id", F.col("e_regular").alias("value"),
                          (F.col("weeks") + F.col("prev")["weeks"]).alias("weeks")))


@query("promo_elasticity", "SELECT upc, store, block_id, " + rnd("value") + ", weeks::INTEGER AS weeks FROM epromo")
def _(spark, d):
    rows = E.with_promo_elasticity(blocks(spark, d)).filter(F.col("e_promo").isNotNull())
    return r6(rows.select("upc", "store", "block_id", F.col("e_promo").alias("value"),
                          (F.col("weeks") + F.col("ref")["weeks"]).alias("weeks")))


# multipliers span many magnitudes, so their logarithm is compared
@query("promo_multipliers", "SELECT upc, store, block_id, metric, " + rnd("ln(greatest(1.0, lift/expected)) AS log_value")
       + ", weeks::INTEGER AS weeks FROM emult")
def _(spark, d):
    rows = E.block_metrics(blocks(spark, d)).filter(F.col("metric").startswith("M_"))
    return r6(rows.select("upc", "store", "block_id", "metric", F.ln("raw_value").alias("log_value"), "weeks"))


@query("multiplier_context", "SELECT upc, store, block_id, metric, " + rnd("ln(lift/expected) AS log_unfloored", "e_ref AS elasticity_used")
       + " FROM emult")
def _(spark, d):
    rows = E.block_metrics(blocks(spark, d)).filter(F.col("unfloored").isNotNull())
    return r6(rows.select("upc", "store", "block_id", "metric", F.ln("unfloored").alias("log_unfloored"), "elasticity_used"))


@query("elasticity_metrics", "SELECT upc, store, key, round(value, 2) AS value, weeks FROM labelled", labelled=LABELLED)
def _(spark, d):
    return E.elasticity_metrics(panel(spark, d))


@query("elasticity_map", """SELECT upc, store, string_agg(key || '=' || printf('%.2f', round(value, 2)) || '/' || weeks, ' ' ORDER BY key) AS metrics
  FROM labelled GROUP BY 1, 2""", labelled=LABELLED)
def _(spark, d):
    rows = E.metrics_map(E.elasticity_metrics(panel(spark, d)))
    entries = F.transform(F.array_sort(F.map_keys("metrics")), lambda k: F.format_string(
        "%s=%.2f/%d", k, F.element_at("metrics", k)["value"], F.element_at("metrics", k)["weeks"]))
    return rows.select("upc", "store", F.array_join(entries, " ").alias("metrics"))


CLEAN_COLS = ("qty", "sales", "modelled_qty", "regular_price", "live_price", "transactions", *DEPTHS)


@query("clean_panel", "SELECT dept, group_code, yr_wk, 'NATIONAL' AS region, " + rnd(*CLEAN_COLS) + ", "
       + ", ".join((*FLAGS, *PAGES)) + " FROM hclean")
def _(spark, d):
    return r6(hclean(spark, d).select("dept", "group_code", "yr_wk", "region", *CLEAN_COLS, *FLAGS, *PAGES))


@query("model_table", "SELECT dept, group_code, yr_wk, t, slot, repaired, "
       + rnd(*CLEAN_COLS, "trend", *[f"coalesce({c},0) AS {c}" for c in LAG_COLUMNS]) + " FROM table_")
def _(spark, d):
    rows = table(spark, d)
    return r6(rows.select("dept", "group_code", "yr_wk", "t", F.col("slot").cast("int").alias("slot"), "repaired",
                          *CLEAN_COLS, "trend", *[F.col(c).cast("double").alias(c) for c in LAG_COLUMNS]))


@query("repair_anomalies", "SELECT group_code, yr_wk, repaired, " + rnd("modelled_qty") + " FROM table_")
def _(spark, d):
    return r6(table(spark, d).select("group_code", "yr_wk", "repaired", "modelled_qty"))


SDET = """SELECT h.* EXCLUDE (det), sea, det-sea AS det FROM
  (SELECT *, coalesce(CASE WHEN slot IS NOT NULL THEN avg(det) OVER (PARTITION BY group_code, slot) END, 0) AS sea
   FROM hdet) h"""


@query("repair_anomalies_seasonal", "SELECT group_code, yr_wk, hit::INTEGER AS repaired, " + rnd(
    "CASE WHEN hit THEN center+trend+sea ELSE modelled_qty END AS modelled_qty") + " FROM hits",
       sdet=SDET, scenter=center("sdet"),
       hits="SELECT d.*, center, yr_wk IN (" + ",".join(map(str, SHOCK_WEEKS))
            + ") AND coalesce(abs(det-center)>2*1.5*mad, false) AS hit FROM sdet d JOIN scenter USING (group_code)")
def _(spark, d):
    p = AnomalyParams(shock_weeks=SHOCK_WEEKS, include_promo=True, seasonal=True)
    return r6(table(spark, d, ModelParams(anomaly=p)).select("group_code", "yr_wk", "repaired", "modelled_qty"))


@query("baseline", "SELECT group_code, yr_wk, " + rnd("baseline_qty") + " FROM base")
def _(spark, d):
    return r6(B.baseline(table(spark, d)).select("group_code", "yr_wk", "baseline_qty"))


@query("promo_lift", "SELECT group_code, yr_wk, " + rnd(
    "baseline_sales", "lift_sales", "lift_share", "qty AS total_qty", "sales AS total_sales", "modelled_qty", "fitted",
    digits=4) + " FROM results")
def _(spark, d):
    return r6(results(spark, d).select("group_code", "yr_wk", "baseline_sales", "lift_sales", "lift_share",
                                       "total_qty", "total_sales", "modelled_qty", "fitted"), 4)


FIT_SQL = """SELECT dept, group_code, count(*) AS n_weeks,
  CASE WHEN max(slot) IS NULL THEN 1 ELSE 52 END AS k, pow(corr(modelled_qty, fitted),2) AS r2,
  CASE WHEN avg((modelled_qty=0)::INTEGER)>0.5 THEN 'Data sparse' ELSE 'Data not sparse' END AS sparsity_status,
  coalesce(avg(abs(fitted-modelled_qty)/modelled_qty) FILTER (modelled_qty>0),0) AS mape,
  sqrt(avg(pow(fitted-modelled_qty,2))) AS rmse, sqrt(avg(pow(trend-modelled_qty,2))) AS trend_rmse FROM base GROUP BY 1, 2"""
FIT_CTES = dict(
    fits=FIT_SQL,
    fcases="""SELECT dept::VARCHAR || '|' || group_code AS id, (r2/k)/((1-r2)/(n_weeks-k-1)) AS f, k::DOUBLE AS d1,
      (n_weeks-k-1)::DOUBLE AS d2 FROM fits""")


def _fit_log_sql(more: str, joined: str) -> str:
    return ("SELECT group_code, dept, 'NATIONAL' AS region, 'Quantity sold' AS volume_status, sparsity_status, n_weeks, "
            + rnd("r2", "1-(1-r2)*(n_weeks-1)/(n_weeks-k-1) AS adj_r2", "f AS f_statistic", "p AS p_value", "mape", "rmse", "trend_rmse",
                  "forecast_wmape", "forecast_mape")
            + f"{more} FROM fits JOIN ftail ON id = dept::VARCHAR || '|' || group_code {joined}")


# the job's log (job_fit_log) has the back-test's errors too
@query("fit_log", _fit_log_sql("", "CROSS JOIN (SELECT NULL::DOUBLE AS forecast_wmape, NULL::DOUBLE AS forecast_mape)"), **FIT_CTES)
def _(spark, d):
    return r6(B.fit_log(results(spark, d)))


@query("rolling_forecasts", "SELECT origin, dept, group_code, yr_wk, " + rnd("forecast", "actual", digits=4) + " FROM oerrors")
def _(spark, d):
    rows = sink.shared(M.prepared_rows(history_panel(spark, d), history_calendar(spark, d), retail.pull_forward_edges(spark, d), PARAMS))
    return r6(BT.rolling_forecasts(rows, BT.origin_weeks(history_weeks(spark, d)), PARAMS), 4)


@query("forecast_errors", "SELECT dept, group_code, n_forecasts, " + rnd("forecast_wmape", "forecast_mape") + " FROM fcerrors")
def _(spark, d):
    rows = sink.shared(M.prepared_rows(history_panel(spark, d), history_calendar(spark, d), retail.pull_forward_edges(spark, d), PARAMS))
    return r6(BT.forecast_errors(BT.rolling_forecasts(rows, BT.origin_weeks(history_weeks(spark, d)), PARAMS)))


@query("forecast", "SELECT dept, group_code, yr_wk, " + rnd(
    "baseline_qty", "qty", "regular_price", "qty*regular_price AS sales", "baseline_qty*regular_price AS baseline_sales",
    "qty*regular_price-baseline_qty*regular_price AS lift_sales",
    """CASE WHEN baseline_qty*regular_price>0 THEN (qty*regular_price-baseline_qty*regular_price)
      /(baseline_qty*regular_price) ELSE 0 END AS lift_share""", digits=3) + ", 1 AS is_forecast FROM ahead")
def _(spark, d):
    return r6(planned(spark, d).select("dept", "group_code", "yr_wk", "baseline_qty", "qty", "regular_price", "sales",
                                       "baseline_sales", "lift_sales", "lift_share", "is_forecast"), 3)


# Least squares on slots and promotions by successive projection: demean within the
# slots, then take out one promotion after the other.
def _projections(terms, name: str, source: str) -> dict[str, str]:
    out = {f"{name}0": "SELECT dept, group_code, yr_wk, up - avg(up) OVER s AS y, " + ", ".join(
        f"{p} - avg({p}) OVER s AS x{i}" for i, p in enumerate(terms))
        + f""" FROM (SELECT *, greatest(modelled_qty-trend, 0) AS up FROM {source})
    WINDOW s AS (PARTITION BY group_code, slot)"""}
    for i in range(len(terms)):
        later = ["y", *[f"x{j}" for j in range(i + 1, len(terms))]]
        out[f"{name}{i + 1}"] = "SELECT dept, group_code, yr_wk, " + ", ".join(
            f"{c} - CASE WHEN sum(x{i}*x{i}) OVER g > 1e-9 THEN x{i}*(sum({c}*x{i}) OVER g)/(sum(x{i}*x{i}) OVER g) "
            f"ELSE 0 END AS {c}" for c in later) + f" FROM {name}{i} WINDOW g AS (PARTITION BY group_code)"
    return out


OLS = _projections(PROMOTIONS, "ols", "table_full")
OLS_CTES = dict(OLS, table_full=TABLE_FULL)


@query("ols_residuals", "SELECT dept, group_code, yr_wk, " + rnd("y AS residual") + f" FROM ols{len(PROMOTIONS)}",
       **OLS_CTES)
def _(spark, d):
    rows = P.detrended_quantity(full_lag_table(spark, d))
    fit = R.ols_residuals(rows, "above_trend", PROMOTIONS, ["dept", "group_code"], "yr_wk", slot="slot")
    return r6(fit.select("dept", "group_code", "yr_wk", "residual"))


PF_CTES = dict(OLS_CTES, longlags=LONG_KEPT,
               seasoned=f"SELECT group_code, yr_wk, y AS resid FROM ols{len(PROMOTIONS)}", corr_=LAG_CORR)


@query("pull_forward_correlation", "SELECT dept, group_code, lag, " + rnd("r") + " FROM corr_", **PF_CTES)
def _(spark, d):
    return r6(P.lag_correlation(P.promo_residuals(full_lag_table(spark, d)), "residual"))


@query("pull_forward", """SELECT group_code AS focus_group, -0.000001::DOUBLE AS correlation_level,
  string_agg('''' || lag || '''', ', ' ORDER BY lag) AS pf_promotions, dept AS focus_dept
  FROM corr_ WHERE r <= -0.000001 GROUP BY group_code, dept""", **PF_CTES)
def _(spark, d):
    return P.pull_forward(full_lag_table(spark, d))


@query("level_shifts")
def _(spark, d):
    return LV.level_shifts(table(spark, d)).select("dept", "group_code", F.explode_outer("breaks").alias("break_after"))


@query("trendless_levels")
def _(spark, d):
    rows = sink.shared(table(spark, d))
    kept = LV.trendless_levels(rows, LV.level_shifts(rows))
    return kept.select("dept", "group_code", F.explode_outer("breaks").alias("break_after"))


@query("level_trend")
def _(spark, d):
    rows = sink.shared(table(spark, d))
    return r6(LV.level_trend(rows, LV.level_shifts(rows)))


@query("seasonal_decompose", "SELECT group_code, t, " + rnd(
    "raw - avg(raw) OVER (PARTITION BY group_code) AS seasonal",
    "above - raw + avg(raw) OVER (PARTITION BY group_code) AS remainder") + """ FROM
  (SELECT group_code, t, modelled_qty-trend AS above,
    avg(modelled_qty-trend) OVER (PARTITION BY group_code, (t-1)%52) AS raw FROM table_)""")
def _(spark, d):
    rows = LV.seasonal_decompose(table(spark, d), "modelled_qty", "trend")
    return r6(rows.select("group_code", "t", "seasonal", "remainder"))


# --- regressions: numbered terms as the plan enters them, with and without holidays ---
OWN = RG.own_terms()
OWN_HOLIDAYS = RG.own_terms(HOLIDAYS)


def _long_terms(names, source: str) -> str:
    value = {"intercept": "1"} | {f"week_{i}": f"coalesce((slot={i})::INTEGER, 0)" for i in range(1, SLOTS + 1)}
    listed = ", ".join(f"coalesce({value.get(n, n)}, 0)::DOUBLE" for n in names)
    return f"""SELECT k, r, i, x FROM (SELECT dept::VARCHAR || '|' || group_code AS k, yr_wk AS r,
      unnest(range({len(names)})) AS i, unnest([{listed}]) AS x FROM {source}) WHERE x<>0
      UNION ALL SELECT dept::VARCHAR || '|' || group_code, yr_wk, {TARGET}, modelled_qty FROM {source}"""


def _named(names, fit: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return (f"SELECT split_part(k, '|', 1)::INTEGER AS dept, split_part(k, '|', 2) AS group_code, ([{listed}])[i+1] AS term, "
            f"coef, std_error, t_value, n, dof, r2, rss FROM {fit} WHERE i<{RG.CROSS_TERMS}")


FIT_VALUES = ("coef", "std_error", "t_value", "r2", "rss")
FIT_COLUMNS = sig(*FIT_VALUES) + ", n, dof"
OWN_FIT = dict(fit_blocks("ownfit", _long_terms(OWN, "table_")), owncoef=_named(OWN, "ownfit"))
HOLIDAY_FIT = dict(fit_blocks("holfit", _long_terms(OWN_HOLIDAYS, "table_h")), holcoef=_named(OWN_HOLIDAYS, "holfit"),
                   table_h="SELECT t.*, " + ", ".join(f"w.{h}" for h in HOLIDAYS) + " FROM table_ t JOIN hweeks w USING (yr_wk)")


def rounded_fit(df: DataFrame) -> DataFrame:
    return five_digits(df, FIT_VALUES)


@query("promo_regression", "SELECT dept, group_code, term, " + FIT_COLUMNS + " FROM owncoef", **OWN_FIT)
def _(spark, d):
    return rounded_fit(RG.promo_regression(table(spark, d)))


def holiday_table(spark, d):
    rows = H.holiday_weeks(cal(spark, d))
    return M.model_table(history_panel(spark, d), history_calendar(spark, d), retail.pull_forward_edges(spark, d), PARAMS, holidays=rows)


@query("promo_regression_holidays", "SELECT dept, group_code, term, " + FIT_COLUMNS + " FROM holcoef", **HOLIDAY_FIT)
def _(spark, d):
    return rounded_fit(RG.promo_regression(holiday_table(spark, d), HOLIDAYS))


CLASSED = """SELECT dept, group_code, term, CASE WHEN coef>=0 THEN 'Positive' ELSE 'Negative' END ||
  CASE WHEN abs(t_value)>=2 THEN '_Significant' ELSE '_Insignificant' END AS class FROM {} WHERE term IN (""" + ", ".join(
    f"'{p}'" for p in PROMOTIONS) + ")"
CLASS_LISTS = ", ".join(f"coalesce(string_agg(term, ', ' ORDER BY term) FILTER (class='{c}'), '') AS {c}" for c in RG.CLASSES)


@query("coefficient_classes", f"SELECT dept, group_code, {CLASS_LISTS} FROM classed GROUP BY 1, 2",
       classed=CLASSED.format("owncoef"), **OWN_FIT)
def _(spark, d):
    return RG.coefficient_classes(RG.promo_regression(table(spark, d)))


@query("insight_classes", "SELECT dept, group_code, 'NATIONAL' AS region, " + sig(*[
    f"coalesce(max(coef) FILTER (term='{p}'), 0) AS {p}" for p in PROMOTIONS]) + f", {CLASS_LISTS.replace('(term', '(c.term')} "
       "FROM holcoef h LEFT JOIN classed c USING (dept, group_code, term) GROUP BY 1, 2", classed=CLASSED.format("holcoef"), **HOLIDAY_FIT)
def _(spark, d):
    return five_digits(RG.insight_classes(RG.promo_regression(holiday_table(spark, d), HOLIDAYS)), PROMOTIONS)


LAG_SHARES = " UNION ALL ".join(f"SELECT dept, group_code, yr_wk, '{c}' AS lag, {c}::DOUBLE AS value FROM table_ WHERE coalesce({c}, 0)<>0"
                                for c in LAG_COLUMNS)


@query("lag_contributions", "SELECT dept, group_code, yr_wk, lag, " + sig("coef*value AS contribution")
       + " FROM lagged l JOIN owncoef c USING (dept, group_code) WHERE term=lag", lagged=LAG_SHARES, **OWN_FIT)
def _(spark, d):
    t = sink.shared(table(spark, d))
    return five_digits(RG.lag_contributions(t, RG.promo_regression(t)), ["contribution"])


@query("wide_coefficients", "SELECT dept, group_code, " + sig(*[
    f"max(coef) FILTER (term='{p}') AS {p}_coef" for p in PROMOTIONS]) + " FROM owncoef GROUP BY 1, 2", **OWN_FIT)
def _(spark, d):
    return five_digits(RG.wide_coefficients(RG.promo_regression(table(spark, d)), PROMOTIONS), [f"{p}_coef" for p in PROMOTIONS])


def _edge_fit(kind: str) -> dict[str, str]:
    """Edge by edge: the target's detrended quantity on the promotions of one focus group."""
    name, key = f"{kind}fit", "target_dept::VARCHAR || '|' || target_group || '|' || focus_dept::VARCHAR || '|' || focus_group"
    number = "CASE promo " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(PROMOTIONS)) + " END"
    value = "CASE promo " + " ".join(f"WHEN '{p}' THEN {p}::DOUBLE" for p in PROMOTIONS) + " END"
    base = f"""SELECT {key} AS k, t.yr_wk AS r, {number} AS i, {value.replace("THEN ", "THEN f.")} AS x, t.modelled_qty-t.trend AS y
      FROM (SELECT * EXCLUDE (promos), unnest(promos) AS promo FROM {kind}_edges) e
      JOIN table_ f ON f.dept=focus_dept AND f.group_code=focus_group
      JOIN table_ t ON t.dept=target_dept AND t.group_code=target_group AND t.yr_wk=f.yr_wk"""
    base = base.replace("THEN f.1", "THEN 1")
    fits = fit_blocks(name, f"""SELECT k, r, i, x FROM {kind}rows WHERE x<>0 UNION ALL SELECT DISTINCT k, r, 0, 1 FROM {kind}rows
      UNION ALL SELECT DISTINCT k, r, {TARGET}, y FROM {kind}rows""")
    listed = ", ".join(f"'{p}'" for p in PROMOTIONS)
    return {f"{kind}rows": base, **fits, f"{kind}coef": f"""SELECT split_part(k, '|', 1)::INTEGER AS target_dept, split_part(k, '|', 2) AS target_group,
      split_part(k, '|', 3)::INTEGER AS focus_dept, split_part(k, '|', 4) AS focus_group, ([{listed}])[i] AS promo, coef FROM {name} WHERE i>0"""}


for _kind in ("cann", "halo"):
    @query(f"relation_coefficients_{_kind}", "SELECT target_dept, target_group, focus_dept, focus_group, promo, " + sig("coef")
           + f" FROM {_kind}coef", **_edge_fit(_kind))
    def _(spark, d, kind=_kind):
        weekly = sink.shared(table(spark, d))
        f = X.cross_features(weekly, retail.relation_edges(spark, d, kind), kind)
        return five_digits(RG.relation_coefficients(weekly, f), ["coef"])


@query("wide_relation_coefficients", "SELECT target_dept AS dept, target_group AS group_code, focus_group, focus_dept, " + sig(*[
    f"max(coef) FILTER (promo='{p}') AS {p}_focus_coef" for p in PROMOTIONS]) + " FROM canncoef GROUP BY 1, 2, 3, 4", **_edge_fit("cann"))
def _(spark, d):
    weekly = sink.shared(table(spark, d))
    f = X.cross_features(weekly, retail.relation_edges(spark, d, "cann"), "cann")
    return five_digits(RG.wide_relation_coefficients(RG.relation_coefficients(weekly, f)), [f"{p}_focus_coef" for p in PROMOTIONS])


RESULT_TERMS = [*PROMOTIONS, *[f"week_{i}" for i in range(1, SLOTS + 1)], *HOLIDAYS, *LAG_COLUMNS, "intercept"]


@query("model_results", "SELECT r.dept, r.group_code, yr_wk, region, " + rnd(
    "qty", "modelled_qty", "baseline_qty", "qty AS total_qty", "baseline_sales", "sales AS total_sales", "lift_sales", "lift_share",
    "trend", "regular_price", "fitted", digits=4) + ", " + sig(*[f"coalesce({t}_coef, 0) AS {t}_coef" for t in RESULT_TERMS],
    *[f"coalesce({c}_coef, 0)*coalesce({c}, 0) AS {c}_contri" for c in LAG_COLUMNS])
    + " FROM (SELECT *, 'NATIONAL' AS region FROM results) r JOIN widecoef w ON w.dept=r.dept AND w.group_code=r.group_code",
       widecoef="SELECT dept, group_code, " + ", ".join(f"max(coef) FILTER (term='{t}') AS {t}_coef" for t in RESULT_TERMS)
       + " FROM holcoef GROUP BY 1, 2", **HOLIDAY_FIT)
def _(spark, d):
    weekly = sink.shared(holiday_table(spark, d))
    wide = RG.model_results(B.baseline_results(weekly), RG.promo_regression(weekly, HOLIDAYS), HOLIDAYS)
    return r6(five_digits(wide, [c for c in wide.columns if c.endswith(("_coef", "_contri"))]), 4)


# --- cross features in the table, and one fit with them ---

def both_edges(spark, d):
    return {kind: retail.relation_edges(spark, d, kind) for kind in ("cann", "halo")}


def cross_table(spark, d):
    """The modelling table with cross features, and their dictionary."""
    weekly = sink.keyed(history_panel(spark, d), ("dept", "group_code"))
    names = sink.shared(X.cross_dictionary(weekly, both_edges(spark, d)))
    return M.model_table(weekly, history_calendar(spark, d), retail.pull_forward_edges(spark, d), PARAMS, names), names


@query("cross_dictionary", "SELECT target_dept, target_group, feature, kind, focus_dept, focus_group, promo, name FROM crossdict")
def _(spark, d):
    names = X.cross_dictionary(history_panel(spark, d), both_edges(spark, d))
    return names.select("target_dept", "target_group", "feature", "kind", "focus_dept", "focus_group", "promo", "name")


@query("model_table_cross", "SELECT dept, group_code, yr_wk, " + rnd("modelled_qty", "trend") + """,
  coalesce(cross_, '') AS cross_features FROM table_ LEFT JOIN (SELECT dept, group_code, yr_wk,
    string_agg(feature::VARCHAR || '=' || printf('%.1f', value), ' ' ORDER BY feature) AS cross_ FROM crossvals WHERE value<>0 GROUP BY 1, 2, 3)
  USING (dept, group_code, yr_wk)""")
def _(spark, d):
    rows, _names = cross_table(spark, d)
    pairs = F.transform(F.array_sort(F.map_entries("cross")), lambda e: F.format_string("%d=%.1f", e["key"], e["value"]))
    return r6(rows.select("dept", "group_code", "yr_wk", "modelled_qty", "trend", F.array_join(pairs, " ").alias("cross_features")))


@query("cross_long", "SELECT dept, group_code, yr_wk, name, value FROM crossvals JOIN table_ USING (dept, group_code, yr_wk) WHERE value<>0")
def _(spark, d):
    rows, names = cross_table(spark, d)
    return X.cross_long(rows, names)


JOINT = fit_blocks("jointfit", _long_terms(OWN, "table_") + f""" UNION ALL SELECT dept::VARCHAR || '|' || group_code, yr_wk,
  {RG.CROSS_TERMS}+feature, value FROM crossvals JOIN table_ USING (dept, group_code, yr_wk) WHERE value<>0""")
JOINT["jointcoef"] = f"""SELECT j.dept, j.group_code, coalesce(kind, 'own') AS kind, coalesce(name, term) AS term, focus_dept, focus_group, promo,
  coef, std_error, t_value, n, dof, r2, rss FROM (SELECT split_part(k, '|', 1)::INTEGER AS dept, split_part(k, '|', 2) AS group_code, i,
    ([{", ".join(f"'{n}'" for n in OWN)}])[i+1] AS term, coef, std_error, t_value, n, dof, r2, rss FROM jointfit) j
  LEFT JOIN crossdict x ON x.target_dept=j.dept AND x.target_group=j.group_code AND x.feature=j.i-{RG.CROSS_TERMS}"""


@query("joint_regression", "SELECT dept, group_code, kind, term, focus_dept, focus_group, promo, " + FIT_COLUMNS + " FROM jointcoef", **JOINT)
def _(spark, d):
    return rounded_fit(RG.joint_regression(*cross_table(spark, d)))


for _kind in ("cann", "halo"):
    @query(f"joint_relations_{_kind}", "SELECT dept, group_code, focus_group, focus_dept, " + sig(*[
        f"max(coef) FILTER (promo='{p}') AS {p}_focus_coef" for p in PROMOTIONS])
        + f" FROM jointcoef WHERE kind='{_kind}' GROUP BY 1, 2, 3, 4", **JOINT)
    def _(spark, d, kind=_kind):
        return five_digits(RG.joint_relations(RG.joint_regression(*cross_table(spark, d)), kind), [f"{p}_focus_coef" for p in PROMOTIONS])


@query("holiday_weeks", "SELECT yr_wk, " + ", ".join(HOLIDAYS) + """, coalesce(lead(good_friday, 1) OVER (ORDER BY yr_wk), 0) AS good_friday_before_1,
  coalesce(lag(good_friday, 1) OVER (ORDER BY yr_wk), 0) AS good_friday_after_1 FROM hweeks""")
def _(spark, d):
    # weeks in which order lines were shipped, so the calendar of the table
    weeks = H.holiday_weeks(cal(spark, d), lead=1, lag=1)
    return weeks.select("yr_wk", *HOLIDAYS, "good_friday_before_1", "good_friday_after_1")


# Least squares on slots, promotions and holidays, as above with more terms
OLS_HOLIDAYS = _projections([*PROMOTIONS, *HOLIDAYS], "ohl", "table_full JOIN hweeks USING (yr_wk)")
PF_HOLIDAYS = dict(OLS_HOLIDAYS, table_full=TABLE_FULL, longlags=LONG_KEPT,
                   seasoned=f"SELECT group_code, yr_wk, y AS resid FROM ohl{len(PROMOTIONS) + len(HOLIDAYS)}", corr_=LAG_CORR)


@query("pull_forward_holidays", """SELECT group_code AS focus_group, -0.000001::DOUBLE AS correlation_level,
  string_agg('''' || lag || '''', ', ' ORDER BY lag) AS pf_promotions, dept AS focus_dept
  FROM corr_ WHERE r <= -0.000001 GROUP BY group_code, dept""", **PF_HOLIDAYS)
def _(spark, d):
    rows = M.model_table(history_panel(spark, d), history_calendar(spark, d), None, PARAMS, holidays=H.holiday_weeks(cal(spark, d)))
    return P.pull_forward(rows, HOLIDAYS)


# --- the whole job -----------------------------------------------------------------------------------------------------

def job_inputs(spark, d):
    w = window(spark, d)
    weekly = gpanel(spark, d, (w.start, w.forecast_end))
    return J.JobInputs(weekly, cal(spark, d), both_edges(spark, d), retail.pull_forward_edges(spark, d), params=PARAMS)


def job_frame(name: str):
    return lambda spark, d: J.job_frames(job_inputs(spark, d), window(spark, d))[name]


STAMP = "(SELECT w FROM wk_end) AS scorecard_wk"
TARGETED = dict(ahead=BLOCKS["ahead"] + " WHERE (dept, group_code) IN (SELECT (dept, group_code) FROM fpanel WHERE flyer_flag=1)")
JOB_FIT = dict(
    fit_blocks("jobfit", _long_terms(OWN_HOLIDAYS, "table_h") + f""" UNION ALL SELECT dept::VARCHAR || '|' || group_code, yr_wk,
      {RG.CROSS_TERMS}+feature, value FROM crossvals JOIN table_ USING (dept, group_code, yr_wk) WHERE value<>0"""),
    jobcoef=_named(OWN_HOLIDAYS, "jobfit"), table_h=HOLIDAY_FIT["table_h"],
    jobcross=f"""SELECT target_dept AS dept, target_group AS group_code, kind, focus_dept, focus_group, promo, coef FROM jobfit
      JOIN crossdict ON k=target_dept::VARCHAR || '|' || target_group AND i={RG.CROSS_TERMS}+feature""",
    widecoef="SELECT dept, group_code, " + ", ".join(f"max(coef) FILTER (term='{t}') AS {t}_coef" for t in RESULT_TERMS)
    + " FROM jobcoef GROUP BY 1, 2", classed=CLASSED.format("jobcoef"))


@query("job_results", "SELECT r.dept, r.group_code, yr_wk, region, " + rnd(
    "qty", "modelled_qty", "baseline_qty", "qty AS total_qty", "baseline_sales", "sales AS total_sales", "lift_sales", "lift_share",
    "trend", "regular_price", "fitted", digits=4) + ", " + sig(*[f"coalesce({t}_coef, 0) AS {t}_coef" for t in RESULT_TERMS],
    *[f"coalesce({c}_coef, 0)*coalesce({c}, 0) AS {c}_contri" for c in LAG_COLUMNS]) + f", {STAMP}, 0 AS is_forecast"
    " FROM (SELECT *, 'NATIONAL' AS region FROM results) r JOIN widecoef w ON w.dept=r.dept AND w.group_code=r.group_code", **JOB_FIT)
def _(spark, d):
    wide = job_frame("results")(spark, d)
    return r6(five_digits(wide, [c for c in wide.columns if c.endswith(("_coef", "_contri"))]), 4)


@query("job_forecast", "SELECT dept, group_code, yr_wk, " + rnd("baseline_qty", "qty", "regular_price", "qty*regular_price AS sales", digits=3)
       + f", 1 AS is_forecast, {STAMP} FROM ahead", **TARGETED)
def _(spark, d):
    return r6(job_frame("forecast")(spark, d).select(
        "dept", "group_code", "yr_wk", "baseline_qty", "qty", "regular_price", "sales", "is_forecast", "scorecard_wk"), 3)


@query("job_insights", "SELECT group_code, dept, insight_type, promo_type, metric, " + rnd("value", digits=4) + f", {STAMP} FROM found",
       found=INSIGHT_SQL, **INSIGHT_CTES, **TARGETED)
def _(spark, d):
    return r6(job_frame("insights")(spark, d).drop("analysis", "recommendation"), 4)


@query("job_classes", "SELECT dept, group_code, 'NATIONAL' AS region, " + sig(*[
    f"coalesce(max(coef) FILTER (term='{p}'), 0) AS {p}" for p in PROMOTIONS]) + f", {CLASS_LISTS.replace('(term', '(c.term')}, {STAMP} "
       "FROM jobcoef h LEFT JOIN classed c USING (dept, group_code, term) GROUP BY 1, 2", **JOB_FIT)
def _(spark, d):
    return five_digits(job_frame("classes")(spark, d), PROMOTIONS)


@query("job_fit_log", _fit_log_sql(f", {STAMP}", "JOIN fcerrors USING (dept, group_code)"), **FIT_CTES)
def _(spark, d):
    return r6(job_frame("fit_log")(spark, d))


for _kind in ("cann", "halo"):
    @query(f"job_{_kind}", "SELECT dept, group_code, focus_group, focus_dept, " + sig(*[
        f"max(coef) FILTER (promo='{p}') AS {p}_focus_coef" for p in PROMOTIONS])
        + f", {STAMP} FROM jobcross WHERE kind='{_kind}' GROUP BY 1, 2, 3, 4", **JOB_FIT)
    def _(spark, d, kind=_kind):
        return five_digits(job_frame(kind)(spark, d), [f"{p}_focus_coef" for p in PROMOTIONS])


@query("job_counts", """SELECT 'results' AS frame, count(*) AS rows FROM results UNION ALL SELECT 'forecast', count(*) FROM ahead
  UNION ALL SELECT 'insights', count(*) FROM found UNION ALL SELECT 'classes', count(DISTINCT (dept, group_code)) FROM results
  UNION ALL SELECT 'fit_log', count(DISTINCT (dept, group_code)) FROM results
  UNION ALL SELECT kind, count(DISTINCT (dept, group_code, focus_dept, focus_group)) FROM crossfit GROUP BY 1""",
       found=INSIGHT_SQL, **INSIGHT_CTES, **TARGETED,
       # relations with a feature that is not zero in every modelled week
       crossfit="""SELECT DISTINCT kind, x.target_dept AS dept, x.target_group AS group_code, focus_dept, focus_group FROM crossdict x
         JOIN crossvals v ON v.dept=x.target_dept AND v.group_code=x.target_group AND v.feature=x.feature
         JOIN table_ t ON t.dept=v.dept AND t.group_code=v.group_code AND t.yr_wk=v.yr_wk WHERE v.value<>0""")
def _(spark, d):
    root = f"{sink.shared_dir(spark)}/job-{uuid.uuid4().hex}"
    return J.run_job(job_inputs(spark, d), window(spark, d), root)
