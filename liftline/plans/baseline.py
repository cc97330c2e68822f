"""Baseline, promotion lift and fit quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import f_upper_tail, ratio_or_null
from ..operators.trend import slot_mean
from ..params import DEFAULT_PRICE, GROUP, REGION, SLOT_SHARE, SLOTS, keys_of


def baseline(table: DataFrame) -> DataFrame:
    """Trend plus the fixed slot share of the quantity where the group has slots."""
    season = F.when(F.col("slot").isNotNull(), F.col("qty") * SLOT_SHARE).otherwise(0.0)
    return table.withColumn("baseline_qty", F.col("trend") + season)


def promo_lift(rows: DataFrame) -> DataFrame:
    """Baseline sales, lift and lift share; totals, modelled and fitted copies."""
    price = F.col("regular_price") if "regular_price" in rows.columns else F.lit(DEFAULT_PRICE)
    fitted = F.col("trend") + F.coalesce(
        slot_mean(rows, F.col("modelled_qty") - F.col("trend")), F.lit(0.0)) \
        if "trend" in rows.columns else F.col("modelled_qty")
    out = rows.withColumn("baseline_sales", F.col("baseline_qty") * price)
    out = out.withColumn("lift_sales", F.col("sales") - F.col("baseline_sales"))
    return out.withColumns({
        "lift_share": F.when(F.col("baseline_sales") > 0, F.col("lift_sales") / F.col("baseline_sales"))
        .otherwise(0.0),
        "total_qty": F.col("qty"),
        "total_sales": F.col("sales"),
        "fitted": fitted,
    })


def fit_metrics(rows: DataFrame, actual: str = "modelled_qty", fitted: str = "fitted",
                keys: Iterable[str] | None = None) -> DataFrame:
    """MAPE over positive actuals, RMSE over all rows, of every series."""
    y, f = F.col(actual), F.col(fitted)
    return rows.groupBy(*(keys_of(rows.columns) if keys is None else keys)).agg(
        F.coalesce(F.avg(F.when(y > 0, F.abs(f - y) / y)), F.lit(0.0)).alias("mape"),
        F.coalesce(F.sqrt(F.avg(F.pow(f - y, 2))), F.lit(0.0)).alias("rmse"),
    )


def fit_log(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per department and group: fit quality of the trend and slot model.

    R2 is the squared correlation of fitted and actual; the F statistic and its p-value
    follow from it. `errors` are a back-test's forecast errors
    (`plans.backtest.forecast_errors`); without them their two columns are null.
    """
    y, f = F.col("modelled_qty"), F.col("fitted")
    # variances and covariance give R2 without dividing by a zero variance
    stats = rows.groupBy("dept", GROUP).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.max("slot").isNotNull().alias("seasonal"),
        F.covar_pop(y, f).alias("cov"), F.var_pop(y).alias("vy"), F.var_pop(f).alias("vf"),
        F.avg((y == 0).cast("double")).alias("zero_share"),
        F.coalesce(F.avg(F.when(y > 0, F.abs(f - y) / y)), F.lit(0.0)).alias("mape"),
        F.coalesce(F.sqrt(F.avg(F.pow(f - y, 2))), F.lit(0.0)).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.col("trend") - y, 2))).alias("trend_rmse"),
    )
    k = F.when(F.col("seasonal"), SLOTS).otherwise(1)
    dof = F.col("n_weeks") - k - 1
    r2 = F.col("r2")
    f_statistic = ratio_or_null(r2 / k, ratio_or_null(1 - r2, dof))
    blank = F.lit(None).cast("double")
    if errors is None:
        stats = stats.withColumns({"forecast_wmape": blank, "forecast_mape": blank})
    else:
        stats = stats.join(errors.select("dept", GROUP, "forecast_wmape", "forecast_mape"), ["dept", GROUP], "left")
    return stats.withColumn(
        "r2", ratio_or_null(F.col("cov") * F.col("cov"), F.col("vy") * F.col("vf"))
    ).withColumn("f_statistic", F.when(dof > 0, f_statistic)).select(
        GROUP, "dept", F.lit(REGION).alias("region"),
        F.lit("Quantity sold").alias("volume_status"),
        F.when(F.col("zero_share") > 0.5, "Data sparse").otherwise("Data not sparse")
        .alias("sparsity_status"),
        "n_weeks", "r2",
        (1 - (1 - r2) * ratio_or_null((F.col("n_weeks") - 1).cast("double"), dof)).alias("adj_r2"),
        "f_statistic", f_upper_tail(F.col("f_statistic"), k, dof).alias("p_value"),
        "mape", "rmse", "trend_rmse", "forecast_wmape", "forecast_mape",
    )


def baseline_results(table: DataFrame) -> DataFrame:
    return promo_lift(baseline(table))
