"""Forecast from a promotion plan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT_IMPACT, DEFAULT_PRICE, PROMOS, RECENT_WEEKS, WEEK, keys_of


def _recent(history: DataFrame) -> DataFrame:
    """Add `rn`: 1 for the series' latest week."""
    return history.withColumn(
        "rn", F.row_number().over(Window.partitionBy(*keys_of(history.columns)).orderBy(F.col(WEEK).desc())))


def baseline_level(history: DataFrame) -> DataFrame:
    """Greater of the last baseline and the mean of the latest weeks."""
    b, keys = F.col("baseline_qty"), keys_of(history.columns)
    agg = _recent(history).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("rn") == 1, b)), F.lit(0.0)).alias("last_level"),
        F.coalesce(F.avg(F.when(F.col("rn") <= RECENT_WEEKS, b)), F.lit(0.0)).alias("mean_level"))
    return agg.select(*keys, F.greatest("last_level", "mean_level").alias("level"))


def promo_impact(history: DataFrame, promos: Iterable[str] = PROMOS) -> DataFrame:
    """Mean lift share per promo over its weeks; a default where it never ran."""
    return history.groupBy(*keys_of(history.columns)).agg(*[
        F.coalesce(F.avg(F.when(F.col(p) > 0, F.col("lift_share"))), F.lit(DEFAULT_IMPACT))
        .alias(f"{p}_impact") for p in promos])


def mean_price(history: DataFrame) -> DataFrame:
    price = F.coalesce(F.nullif(F.avg("regular_price"), F.lit(0.0)), F.lit(DEFAULT_PRICE))
    return history.groupBy(*keys_of(history.columns)).agg(price.alias("price"))


def group_levels(history: DataFrame, promos: Iterable[str] = PROMOS) -> DataFrame:
    """Level, price and impacts of every series in one aggregate."""
    promos = list(promos)
    b, rn = F.col("baseline_qty"), F.col("rn")
    agg = _recent(history).groupBy(*keys_of(history.columns)).agg(
        F.coalesce(F.max(F.when(rn == 1, b)), F.lit(0.0)).alias("last_level"),
        F.coalesce(F.avg(F.when(rn <= RECENT_WEEKS, b)), F.lit(0.0)).alias("mean_level"),
        F.coalesce(F.nullif(F.avg("regular_price"), F.lit(0.0)), F.lit(DEFAULT_PRICE)).alias("price"),
        *[F.coalesce(F.avg(F.when(F.col(p) > 0, F.col("lift_share"))), F.lit(DEFAULT_IMPACT))
          .alias(f"{p}_impact") for p in promos])
    return agg.withColumn("level", F.greatest("last_level", "mean_level")).drop("last_level", "mean_level")


def forecast(history: DataFrame, plan: DataFrame, promos: Iterable[str] = PROMOS, carry: Iterable[str] = ()) -> DataFrame:
    """Planned weeks with quantity, sales and lift.

    `history` carries baseline and lift share; `plan` is a clean, dense panel of
    the horizon weeks. Groups without history or without a plan are left out. Columns
    of the plan named in `carry` come along as carried_<name>.
    """
    promos = [p for p in promos if p in plan.columns]
    factors = [F.when(F.col(p) > 0, 1 + F.col(f"{p}_impact")).otherwise(1.0) for p in promos]
    keys = keys_of(history.columns)
    joined = plan.join(group_levels(history, promos), keys)
    out = joined.select(
        *keys, WEEK, *promos, *[F.col(c).alias(f"carried_{c}") for c in carry],
        F.col("level").alias("baseline_qty"),
        (F.col("level") * reduce(lambda a, b: a * b, factors, F.lit(1.0))).alias("qty"),
        F.col("price").alias("regular_price"),
    )
    out = out.withColumns({
        "sales": F.col("qty") * F.col("regular_price"),
        "baseline_sales": F.col("baseline_qty") * F.col("regular_price"),
    })
    out = out.withColumn("lift_sales", F.col("sales") - F.col("baseline_sales"))
    return out.withColumns({
        "lift_share": F.when(F.col("baseline_sales") > 0, F.col("lift_sales") / F.col("baseline_sales"))
        .otherwise(0.0),
        "total_qty": F.col("qty"),
        "total_sales": F.col("sales"),
        "modelled_qty": F.col("qty"),
        "fitted": F.col("qty"),
        "is_forecast": F.lit(1),
    })
