"""Promotion lags that go with lower later sales ("pull-forward")."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quoted_list, ratio_or_null
from ..operators.features import lags_long, skip_empty
from ..operators.regression import ols_residuals
from ..params import GROUP, PROMOTIONS, PULL_FORWARD_LEVELS, WEEK


def detrended_quantity(table: DataFrame) -> DataFrame:
    """Modelled quantity above trend, floored at 0; groups never sold are left out."""
    return skip_empty(table).withColumn(
        "above_trend", F.greatest(F.col("modelled_qty") - F.col("trend"), F.lit(0.0)))


def lag_correlation(rows: DataFrame, residual: str) -> DataFrame:
    """Pearson correlation of the residual with every lag that varies, per group."""
    long = lags_long(rows, carry=(residual,))
    agg = long.groupBy("dept", GROUP, "lag").agg(
        F.covar_pop(residual, "value").alias("cov"),
        F.stddev_pop(residual).alias("sd_residual"), F.stddev_pop("value").alias("sd_lag"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max(F.abs(F.col(residual))).alias("peak"))
    return (agg.filter((F.col("lo") < F.col("hi")) & (F.col("peak") > 0))
            .select("dept", GROUP, "lag",
                    ratio_or_null(F.col("cov"), F.col("sd_residual") * F.col("sd_lag")).alias("r")))


def negative_lags(correlations: DataFrame,
                  levels: Iterable[float] = PULL_FORWARD_LEVELS) -> DataFrame:
    """Quoted list of the lags at or below each level, per group; empty lists are left out."""
    level = F.explode(F.array(*[F.lit(float(v)) for v in levels]))
    # at most one row per promotion and lag in a group, which bounds the list
    return (
        correlations.withColumn("correlation_level", level)
        .filter(F.col("r") <= F.col("correlation_level"))
        .groupBy("dept", GROUP, "correlation_level")
        .agg(quoted_list(F.collect_list("lag")).alias("pf_promotions"))
        .select(F.col(GROUP).alias("focus_group"), "correlation_level", "pf_promotions",
                F.col("dept").alias("focus_dept"))
    )


def promo_residuals(table: DataFrame, holidays: Iterable[str] = ()) -> DataFrame:
    """Lags with the residual of the detrended quantity on promos, slots and holidays."""
    lags = [c for c in table.columns if "_lag_" in c]
    return ols_residuals(detrended_quantity(table), "above_trend", [*PROMOTIONS, *holidays],
                         ["dept", GROUP], WEEK, slot="slot", carry=lags).drop("fitted")


def pull_forward(table: DataFrame, holidays: Iterable[str] = (),
                 levels: Iterable[float] = PULL_FORWARD_LEVELS) -> DataFrame:
    return negative_lags(lag_correlation(promo_residuals(table, holidays), "residual"), levels)
