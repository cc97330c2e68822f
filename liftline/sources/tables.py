"""Table and file readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_name, parse_quoted_list
from ..params import GROUP, WEEK
from ..schema import PRICE_PANEL


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv_panel(spark: SparkSession, path: str, schema=PRICE_PANEL) -> DataFrame:
    """Price panel from CSV files with a header, under an explicit schema.

    Prices and measures stay text here; `operators.clean` turns them into
    numbers and drops what cannot be read.
    """
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_panel(panel: DataFrame, week_lo, week_hi, depts: Iterable[int] | None = None) -> DataFrame:
    """Rows of the given departments between two weeks.

    The bounds are ints or scalar columns (see `operators.calendar`). On a stored
    panel plain filters reach the scan; a panel that is made of order lines takes its
    bounds as `sources.retail.group_panel(..., weeks)`, which prunes the lines.
    """
    out = panel.filter(F.col(WEEK).between(week_lo, week_hi))
    return out if depts is None else out.filter(F.col("dept").isin(list(depts)))


def scan_edges(edges: DataFrame, depts: Iterable[int] | None = None,
               dept_column: str = "focus_dept") -> DataFrame:
    """Relation edges of the given departments, promo list parsed to an array."""
    out = edges if depts is None else edges.filter(F.col(dept_column).isin(list(depts)))
    if dict(out.dtypes)["promos"] == "string":
        out = out.withColumn("promos", parse_quoted_list(F.col("promos")))
    return out


def future_targets(plan: DataFrame, week_lo, week_hi, depts: Iterable[int] | None = None) -> DataFrame:
    """Distinct (group, department) with a flyer in the planned weeks."""
    return (
        scan_panel(plan, week_lo, week_hi, depts)
        .filter(F.col("flyer_flag") == 1)
        .select(GROUP, "dept")
        .distinct()
    )


def normalize_columns(df: DataFrame, table_prefix: str | None = None) -> DataFrame:
    """All names lower case, without table prefix, dots as underscores."""
    return df.toDF(*[clean_name(c, table_prefix) for c in df.columns])


def cast_columns(df: DataFrame, strings: Iterable[str] = (), ints: Iterable[str] = (),
                 doubles: Iterable[str] = ()) -> DataFrame:
    """One projection of try_casts; bad text becomes null."""
    target = {c: "string" for c in strings} | {c: "int" for c in ints} | {c: "double" for c in doubles}
    return df.select(*[
        F.col(f"`{c}`").try_cast(target[c]).alias(c) if c in target else F.col(f"`{c}`")
        for c in df.columns
    ])


def register_view(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Hash-partition by the series keys once and publish a temporary view."""
    out = df.repartition(*keys) if keys else df
    out.createOrReplaceTempView(name)
    return out


def stamp(df: DataFrame, scorecard_wk, is_forecast: int | None = None, dept: int | None = None) -> DataFrame:
    """Add the scorecard week and, where given, forecast flag and department."""
    cols = {"scorecard_wk": scorecard_wk if not isinstance(scorecard_wk, int) else F.lit(scorecard_wk)}
    if is_forecast is not None:
        cols["is_forecast"] = F.lit(is_forecast)
    if dept is not None:
        cols["dept"] = F.lit(dept)
    return df.withColumns(cols)
