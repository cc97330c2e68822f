"""Trend, seasonality and robust centre as window expressions, all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import in_weeks
from ..params import WEEK, AnomalyParams, keys_of
from .clean import has_promo
from .features import by_group, week_index


def first_sale(panel: DataFrame, measure: str = "modelled_qty") -> DataFrame:
    """Week index `t` and the index of the group's first week with sales."""
    indexed = panel if "t" in panel.columns else week_index(panel)
    return indexed.withColumn(
        "first_t", F.min(F.when(F.col(measure) > 0, F.col("t"))).over(by_group(panel)))


def linear_trend(panel: DataFrame, measure: str = "modelled_qty") -> DataFrame:
    """Least-squares line from the first sale on, 0 before it.

    Without any sale the mean; with a single week from the first sale on, its value.
    """
    g = by_group(panel)
    staged = first_sale(panel, measure)
    y = F.when(F.col("t") >= F.col("first_t"), F.col(measure))
    staged = staged.withColumns({
        "trend_slope": F.regr_slope(y, F.col("t")).over(g),
        "trend_base": F.regr_intercept(y, F.col("t")).over(g),
        "trend_mean": F.avg(measure).over(g),
    })
    line = F.coalesce(F.col("trend_base") + F.col("trend_slope") * F.col("t"), F.col(measure))
    trend = (
        F.when(F.col("first_t").isNull(), F.col("trend_mean"))
        .when(F.col("t") < F.col("first_t"), F.lit(0.0))
        .otherwise(line)
    )
    return staged.withColumn("trend", trend).drop("trend_slope", "trend_base", "trend_mean", "first_t")


def slot_mean(frame: DataFrame, value: Column) -> Column:
    """Mean of the value in its series and slot: the least-squares fit on slot dummies."""
    return F.when(F.col("slot").isNotNull(), F.avg(value).over(Window.partitionBy(*keys_of(frame.columns), "slot")))


def seasonal_adjust(panel: DataFrame, measure: str, out: str) -> DataFrame:
    """Residual of the measure on the slot dummies; unchanged without slots."""
    return panel.withColumn(out, F.col(measure) - F.coalesce(slot_mean(panel, F.col(measure)), F.lit(0.0)))


def robust_center(panel: DataFrame, value: str, promo: Column, scale: float) -> DataFrame:
    """Columns center, spread: median and scaled MAD of the non-promo weeks.

    A zero MAD falls back to all weeks. Groups without a non-promo week get nulls.
    """
    g = by_group(panel)
    calm = F.when(~promo, F.col(value))
    staged = panel.withColumns({"center_np": F.median(calm).over(g),
                                "center_all": F.median(F.col(value)).over(g)})
    staged = staged.withColumns({
        "mad_np": F.median(F.when(~promo, F.abs(F.col(value) - F.col("center_np")))).over(g),
        "mad_all": F.median(F.abs(F.col(value) - F.col("center_all"))).over(g),
    })
    flat = F.col("mad_np") == 0
    return staged.withColumns({
        "center": F.when(flat, F.col("center_all")).otherwise(F.col("center_np")),
        "spread": F.when(flat, F.col("mad_all")).otherwise(F.col("mad_np")) * scale,
    }).drop("center_np", "center_all", "mad_np", "mad_all")


def repair_anomalies(panel: DataFrame, params: AnomalyParams) -> DataFrame:
    """Replace outlying quantities in the listed weeks; adds `repaired` 0/1.

    Input columns: modelled_qty, trend, slot and the promotion columns.
    """
    seasonal = slot_mean(panel, F.col("modelled_qty") - F.col("trend")) if params.seasonal else F.lit(None)
    staged = panel.withColumn("season", F.coalesce(seasonal.cast("double"), F.lit(0.0)))
    staged = staged.withColumn("detrended", F.col("modelled_qty") - F.col("trend") - F.col("season"))
    promo = has_promo()
    staged = robust_center(staged, "detrended", promo, params.scale)
    away = F.abs(F.col("detrended") - F.col("center")) > params.bound * F.col("spread")
    may_repair = F.lit(True) if params.include_promo else ~promo
    bad = F.coalesce(in_weeks(F.col(WEEK), params.shock_weeks) & away & may_repair, F.lit(False))
    return staged.withColumns({
        "repaired": bad.cast("int"),
        "modelled_qty": F.when(bad, F.col("center") + F.col("trend") + F.col("season"))
        .otherwise(F.col("modelled_qty")),
    }).drop("season", "detrended", "center", "spread")
