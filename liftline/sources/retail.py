"""Adapter: order lines to weekly panels, calendar, relation edges and plan.

Line measures become integers (cents, whole percents, units) before they are
summed, so sums and half-up prices are exact and do not depend on how the data
is partitioned. Lines are summed by series and week first; everything after
that works on at most one row per series and week.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import half_up
from ..params import GROUP, SERIES, WEEK
from .tables import read_table


def iso_week(day: Column) -> Column:
    """ISO year * 100 + ISO week."""
    year = F.call_function("date_part", F.lit("YEAROFWEEK"), day)
    return (year * 100 + F.weekofyear(day)).cast("int")


def _monday(ts: Column) -> Column:
    # date arithmetic, so the session time zone plays no part
    day = ts.cast("date")
    return F.date_sub(day, F.weekday(day))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free weeks (yr_wk, start_date, end_date) between first and last shipment.

    One job reads a single column for two dates; the weeks between them are
    generated, so plans that use the calendar often do not scan the lines again.
    """
    span = read_table(spark, sf_dir, "lineitem").agg(
        F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    lo, hi = span.select(_monday(F.col("lo")), _monday(F.col("hi"))).first()
    weeks = (hi - lo).days // 7 + 1 if lo is not None else 0
    days = spark.range(weeks).select(
        F.date_add(F.lit(lo), (F.col("id") * 7).cast("int")).alias("start_date"))
    return days.select(
        iso_week(F.col("start_date")).alias(WEEK), "start_date",
        F.date_add("start_date", 6).alias("end_date"))


def calendar_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calendar as a plan that reads the lines' days when it runs, for jobs that use it once."""
    span = read_table(spark, sf_dir, "lineitem").agg(
        _monday(F.min("l_shipdate")).alias("lo"), _monday(F.max("l_shipdate")).alias("hi")).filter("lo IS NOT NULL")
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("start_date"))
    return days.select(iso_week(F.col("start_date")).alias(WEEK), "start_date", F.date_add("start_date", 6).alias("end_date"))


def line_days(week_lo: int, week_hi: int) -> tuple[date, date]:
    """First day and the day after the last of the lines that decide the panel's weeks from week_lo to week_hi.

    Regular prices are means of whole quarters, so the days cover every week that
    begins in the quarters of the two weeks.
    """
    lo, hi = (date.fromisocalendar(*divmod(w, 100), 1) for w in (week_lo, week_hi))
    first = date(lo.year, (lo.month - 1) // 3 * 3 + 1, 1)
    months = hi.year * 12 + (hi.month - 1) // 3 * 3 + 3
    return first, date(months // 12, months % 12 + 1, 1) + timedelta(days=6)


def _lines(spark: SparkSession, sf_dir: str, weeks: tuple[int, int] | None = None) -> DataFrame:
    """Order lines in integers; with weeks only those that decide them, by literal bounds that reach the scan."""
    lines = read_table(spark, sf_dir, "lineitem")
    if weeks is not None:
        kind = lines.schema["l_shipdate"].dataType
        first, after = (F.lit(f"{d} 00:00:00").cast(kind) for d in line_days(*weeks))
        lines = lines.filter((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pct = F.round(F.col("l_discount") * 100).cast("bigint")
    return lines.select(
        "l_partkey", "l_suppkey",
        _monday(F.col("l_shipdate")).alias("wk_start"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        cents.alias("cents"), pct.alias("pct"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
    )


#: weekly integer sums over the order lines of a series
FACTS = {
    "n": "count(1)",
    "qty": "sum(qty)",
    "cents": "sum(cents)",
    "net": "sum(cents * (100 - pct))",
    "pct": "sum(pct)",
    "kept_n": "count_if(rf <> 'R')",
    "kept_qty": "sum(if(rf <> 'R', qty, 0L))",
    "kept_net": "sum(if(rf <> 'R', cents * (100 - pct), 0L))",
    "qty_a": "sum(if(rf = 'A', qty, 0L))",
    "qty_n": "sum(if(rf = 'N', qty, 0L))",
    "qty_r": "sum(if(rf = 'R', qty, 0L))",
    "qty_f": "sum(if(ls = 'F', qty, 0L))",
    "qty_o": "sum(if(ls = 'O', qty, 0L))",
}


def _facts(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Integer sums per series and week; partial aggregation before the shuffle."""
    facts = lines.groupBy(*keys, "wk_start").agg(*[F.expr(f"{e} AS {n}") for n, e in FACTS.items()])
    # one shuffle of the small weekly rows; every later window on the series reuses it
    facts = facts.repartition(*keys)
    quarter = Window.partitionBy(*keys, F.year("wk_start"), F.quarter("wk_start"))
    return facts.withColumns({
        WEEK: iso_week(F.col("wk_start")),
        "regular_cents": half_up(F.sum("cents").over(quarter), F.sum("qty").over(quarter)),
    })


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price panel: one row per product x store x week.

    Product is the part brand, store the supplier's region. Sides are joined
    without hints: Spark broadcasts those below its size threshold, sort-merges
    the others, and splits hot keys at run time (adaptive skew join).
    """
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("upc"))
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    stores = (
        read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_regionkey").cast("string").alias("store"))
    )
    lines = (
        _lines(spark, sf_dir)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    # net_units and net_sales are net of returned lines and may be negative
    return _facts(lines, SERIES).withColumn(
        "retail_cents", half_up(F.expr("regular_cents * (100 * n - pct)"), F.expr("100 * n"))
    ).selectExpr(
        *SERIES, WEEK,
        "regular_cents / 100D AS regular_price",
        "if(kept_n > 0, retail_cents / 100D, NULL) AS retail_price",
        "double(qty) AS units",
        "net / 10000D AS sales",
        "int(pct > 5 * n) AS instore_promo",
        "int(qty_r > qty_a) AS flyer",
        "if(qty_f <> qty_o, int(qty_f > qty_o), NULL) AS cpp",
        "double(2 * kept_qty - qty) AS net_units",
        "(2 * kept_net - net) / 10000D AS net_sales",
    )


def _brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("int")


def dept_of(brand: Column) -> Column:
    return (_brand_number(brand) % 5).cast("int")


def group_panel(spark: SparkSession, sf_dir: str, weeks: tuple[int, int] | None = None) -> DataFrame:
    """Group panel: one row per product group x week with sales, of all weeks or of those from one to another."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", dept_of(F.col("p_brand")).alias("dept"), F.col("p_brand").alias(GROUP))
    lines = _lines(spark, sf_dir, weeks).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # a promotion week has a mean discount above 5 %; transactions are net of returns
    facts = _facts(lines, ("dept", GROUP)).withColumns({
        "promo": F.expr("pct > 5 * n"),
        "live_cents": half_up(F.expr("kept_net"), F.expr("100 * kept_qty")),
    })
    if weeks is not None:
        facts = facts.filter(F.col(WEEK).between(*weeks))
    return facts.selectExpr(
        "dept", GROUP, WEEK,
        "double(qty) AS qty",
        "net / 10000D AS sales",
        "if(promo AND qty_a >= qty_n AND qty_a >= qty_r, pct / double(n), 0D) AS pa_depth",
        "if(promo AND qty_n > qty_a AND qty_n >= qty_r, pct / double(n), 0D) AS ar_depth",
        "if(promo AND qty_r > qty_a AND qty_r > qty_n, pct / double(n), 0D) AS tr_depth",
        "if(promo, element_at(array('FRONT', 'BACK', 'INSIDE', NULL), int(qty % 4) + 1), NULL) AS page_location",
        "int(promo AND qty_r > qty_a) AS flyer_flag",
        "int(promo AND qty_f > qty_o) AS cpp_flag",
        "int(promo AND qty % 3 = 0) AS digital_flag",
        "int(promo AND n % 5 = 0) AS digest_flag",
        "regular_cents / 100D AS regular_price",
        "coalesce(live_cents / 100D, 0D) AS live_price",
        "double(2 * kept_n - n) AS transactions",
    )


def relation_edges(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Edges between brand numbers: k -> k+5 (cannibalization), k -> k+1 (halo).

    The promo list is text, as a relation table delivers it.
    """
    step = {"cann": 5, "halo": 1}[kind]
    brands = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("focus_group")).distinct()
    k = _brand_number(F.col("focus_group"))
    target = (k + step - 1) % 25 + 1
    return brands.select(
        "focus_group",
        F.concat(F.lit("Brand#"), target.cast("string")).alias("target_group"),
        dept_of(F.col("focus_group")).alias("focus_dept"),
        (target % 5).cast("int").alias("target_dept"),
        F.when(k % 3 == 0, "'cpp_flag', 'pa_depth'").when(k % 3 == 1, "'digital_flag'")
        .otherwise("'tr_depth', 'page_front', 'digest_flag'").alias("promos"),
    )


def pull_forward_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed lags per group, as a relation table delivers them."""
    brands = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("focus_group")).distinct()
    k = _brand_number(F.col("focus_group"))
    return brands.select(
        "focus_group", dept_of(F.col("focus_group")).alias("focus_dept"),
        F.when(k % 2 == 0, "'cpp_flag_lag_1', 'pa_depth_lag_2'")
        .otherwise("'tr_depth_lag_4', 'digital_flag_lag_1', 'page_back_lag_3'").alias("promos"),
    )
