"""Row-level cleaning: projections and filters only, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import any_nonzero, any_positive, clamp_nonneg, promo_class, to_number
from ..params import DEPTHS, FLAGS, KEYS, PAGES, PROMOTIONS, REGION, WEEK


def drop_incomplete(panel: DataFrame) -> DataFrame:
    """Drop rows without week, keys, regular price, units or sales, after casting."""
    typed = panel.withColumns({c: to_number(F.col(c)) for c in ("units", "sales")})
    return typed.na.drop(subset=[WEEK, "upc", "store", "regular_price", "units", "sales"])


def drop_negative(panel: DataFrame, columns: Iterable[str] = ("sales", "units")) -> DataFrame:
    out = panel
    for c in columns:
        out = out.filter(F.col(c) >= 0)
    return out


def effective_price(panel: DataFrame) -> DataFrame:
    """Retail falls back to regular, and equals it off in-store promotion."""
    regular = to_number(F.col("regular_price"))
    raw = F.col("retail_price")
    missing = raw.isNull() | F.coalesce(F.isnan(raw.try_cast("double")), F.lit(False))
    retail = (
        F.when((F.col("instore_promo") == 0) | missing, regular)
        .otherwise(to_number(raw))
    )
    return (
        panel.withColumns({"regular_price": regular, "retail_price": retail})
        .na.drop(subset=["regular_price", "retail_price"])
    )


def with_promo_type(panel: DataFrame) -> DataFrame:
    return panel.withColumn(
        "promo_type", promo_class(F.col("instore_promo"), F.col("flyer"), F.col("cpp")))


def round_depths(panel: DataFrame, columns: Iterable[str] = DEPTHS) -> DataFrame:
    return panel.withColumns({c: F.round(c, 1) for c in columns if c in panel.columns})


def clamp_measures(panel: DataFrame,
                   columns: Iterable[str] = ("sales", "transactions", "modelled_qty")) -> DataFrame:
    """Negative measures become 0, each where the column exists; nulls stay null."""
    return panel.withColumns({c: clamp_nonneg(F.col(c)) for c in columns if c in panel.columns})


def one_hot_page(panel: DataFrame) -> DataFrame:
    """Page location to three 0/1 columns; ready-made 0/1 columns are kept."""
    if "page_location" in panel.columns:
        flags = {p: F.when(F.col("page_location") == p.removeprefix("page_").upper(), 1).otherwise(0)
                 for p in PAGES}
        return panel.withColumns(flags).drop("page_location")
    missing = {p: F.lit(0) for p in PAGES if p not in panel.columns}
    return panel.withColumns(missing) if missing else panel


def page_location_text(panel: DataFrame) -> DataFrame:
    if "page_location" not in panel.columns:
        return panel
    return panel.withColumn("page_location", F.col("page_location").cast("string"))


def zero_fill(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Numeric nulls to 0, by default in all columns but the keys and the week, which stay as they are."""
    if columns is None:
        kept = {*KEYS, WEEK}
        columns = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in kept]
    return df.na.fill(0, subset=list(columns))


def default_region(df: DataFrame) -> DataFrame:
    return df if "region" in df.columns else df.withColumn("region", F.lit(REGION))


def has_promo(promotions: Iterable[str] = PROMOTIONS) -> Column:
    """True where any promotion column is not 0."""
    return any_nonzero([F.col(p) for p in promotions])


def on_promo_in_week(panel: DataFrame, scorecard_wk) -> DataFrame:
    """Distinct groups with any of the four promo flags on in the week."""
    return (
        panel.filter(F.col(WEEK) == scorecard_wk)
        .filter(any_positive([F.col(f) for f in FLAGS]))
        .select("dept", "group_code").distinct()
    )


def select_family(df: DataFrame, pattern: str, keys: Iterable[str] = ()) -> DataFrame:
    """Key columns plus the columns whose whole name matches the pattern."""
    return df.select(*[F.col(k) for k in keys], df.colRegex(f"`{pattern}`"))


def order_columns(df: DataFrame, template: Iterable[str]) -> DataFrame:
    return df.select(*template)
