"""Rule-based insights, one aggregate per side for all groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import active_promos, percent_text, ratio_or_null, units_text
from ..params import GROUP, PROMOS, RECENT_WEEKS, WEEK, keys_of

# --- fixed values: columns of the insight frame; the types and metric codes below are fixed too ---
FIELDS = ("insight_type", "promo_type", "metric", "value", "analysis", "recommendation")
# --- end of fixed values ---


def promo_effectiveness(history: DataFrame, promos: Iterable[str] = PROMOS) -> DataFrame:
    """Per group and promo: lift share, quantity and sales on and off promo, ROI.

    Only promos with weeks on both sides.
    """
    promos = list(promos)
    typed = history.select("dept", GROUP, "qty", "sales", "lift_share",
                           *[F.col(p).cast("double").alias(p) for p in promos])
    long = typed.unpivot(["dept", GROUP, "qty", "sales", "lift_share"], promos, "promo", "strength")
    on, off = F.col("strength") > 0, F.col("strength") == 0
    agg = long.groupBy("dept", GROUP, "promo").agg(
        F.count(F.when(on, 1)).alias("weeks_on"), F.count(F.when(off, 1)).alias("weeks_off"),
        F.avg(F.when(on, F.col("lift_share"))).alias("avg_lift"),
        *[F.avg(F.when(side, F.col(m))).alias(f"{m}_{label}")
          for m in ("qty", "sales") for side, label in ((on, "on"), (off, "off"))])
    roi = F.when(F.col("sales_off") > 0, (F.col("sales_on") - F.col("sales_off")) / F.col("sales_off"))
    return (agg.filter((F.col("weeks_on") > 0) & (F.col("weeks_off") > 0))
            .withColumn("roi", F.coalesce(roi, F.lit(0.0))))


def best_week(rows: DataFrame, promos: Iterable[str] = PROMOS) -> DataFrame:
    """Week with the largest quantity per group; the earliest wins a tie."""
    return _extreme_week(rows, promos, F.col("qty").desc())


def worst_week(rows: DataFrame, promos: Iterable[str] = PROMOS) -> DataFrame:
    """Week with the smallest positive quantity per group; the earliest wins a tie."""
    return _extreme_week(rows.filter(F.col("qty") > 0), promos, F.col("qty").asc())


def _extreme_week(rows: DataFrame, promos: Iterable[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys_of(rows.columns)).orderBy(order, F.col(WEEK))
    return (rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .select("dept", GROUP, WEEK, "qty", active_promos(promos).alias("active")))


def forecast_vs_recent(history: DataFrame, planned: DataFrame) -> DataFrame:
    """Mean forecast against the mean of the latest actual weeks."""
    keys = keys_of(history.columns)
    w = Window.partitionBy(*keys).orderBy(F.col(WEEK).desc())
    recent = (history.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= RECENT_WEEKS)
              .groupBy(*keys).agg(F.avg("qty").alias("recent_qty")))
    ahead = planned.groupBy(*keys).agg(F.avg("qty").alias("forecast_qty"))
    change = F.when(F.col("recent_qty") > 0,
                    (F.col("forecast_qty") - F.col("recent_qty")) / F.col("recent_qty")).otherwise(0.0)
    return recent.join(ahead, keys).withColumn("pct_change", change)


def _insight(kind: str, promo: str, metric: str, value: Column, analysis: Column,
             recommendation: Column, keep: Column) -> Column:
    row = F.struct(F.lit(kind).alias("insight_type"), F.lit(promo).alias("promo_type"),
                   F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                   analysis.alias("analysis"), recommendation.alias("recommendation"))
    return F.when(keep, row)


def _unfold(agg: DataFrame, rows: list[Column]) -> DataFrame:
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return agg.select(GROUP, "dept", F.inline(present)).select(GROUP, "dept", *FIELDS)


def _history_aggregate(history: DataFrame, promos: list[str]) -> DataFrame:
    """Everything the insights need from the past, one row per group."""
    week = F.struct(F.col(WEEK).alias("wk"), F.col("qty").alias("qty"), active_promos(promos).alias("active"))
    latest = Window.partitionBy("dept", GROUP).orderBy(F.col(WEEK).desc())
    aggs = [
        F.max_by(week, F.struct(F.col("qty"), -F.col(WEEK))).alias("best"),
        F.min_by(week, F.when(F.col("qty") > 0, F.struct(F.col("qty"), F.col(WEEK)))).alias("worst"),
        F.avg(F.when(F.col("rn") <= RECENT_WEEKS, F.col("qty"))).alias("recent_qty"),
    ]
    for p in promos:
        on, off = F.col(p) > 0, F.col(p) == 0
        aggs += [F.count(F.when(on, 1)).alias(f"{p}_n"), F.count(F.when(off, 1)).alias(f"{p}_m"),
                 F.avg(F.when(on, F.col("lift_share"))).alias(f"{p}_lift"),
                 F.avg(F.when(on, F.col("sales"))).alias(f"{p}_on"),
                 F.avg(F.when(off, F.col("sales"))).alias(f"{p}_off")]
    return history.withColumn("rn", F.row_number().over(latest)).groupBy(GROUP, "dept").agg(*aggs)


def _history_rows(promos: list[str]) -> list[Column]:
    rows = []
    for p in promos:
        lift = F.coalesce(F.col(f"{p}_lift"), F.lit(0.0))
        roi = F.when(F.col(f"{p}_off") > 0,
                     ratio_or_null(F.col(f"{p}_on") - F.col(f"{p}_off"), F.col(f"{p}_off"))).otherwise(0.0)
        rows.append(_insight(
            "PROMO_EFFECTIVENESS", p, "LIFT_PCT", lift,
            F.concat(F.lit("Mean lift over baseline: "), percent_text(lift), F.lit(f" in weeks with {p}")),
            F.when(roi > 0.2, "Promote more often").when(roi > 0, "Keep promoting as often")
            .otherwise("Promote less often"),
            (F.col(f"{p}_n") > 0) & (F.col(f"{p}_m") > 0)))
    for name, label, advice in (("best", "Best", "Plan these promotions again: "),
                                ("worst", "Worst", "Plan without these promotions: ")):
        w = F.col(name)
        rows.append(_insight(
            f"{label.upper()}_WEEK", "ALL", "QTY", w["qty"],
            F.concat(F.lit(f"{label} week: "), w["wk"].cast("string"), F.lit(", "),
                     units_text(w["qty"]), F.lit(" units")),
            F.concat(F.lit(advice), w["active"]), w.isNotNull()))
    return rows


def _forecast_rows() -> list[Column]:
    b = F.col("ahead")
    recent, ahead = F.col("recent_qty"), F.col("forecast_qty")
    change = F.when(recent > 0, (ahead - recent) / recent).otherwise(0.0)
    return [
        _insight(
            "FORECAST_TREND", "ALL", "QTY", change,
            F.concat(F.lit("Expected quantity goes "), F.when(ahead > recent, "up").otherwise("down"),
                     F.lit(" by "), percent_text(F.abs(change)), F.lit(" against the last weeks' mean")),
            F.when(change < 0, "Look for promotions that lift the coming weeks").otherwise("Keep the planned promotions"),
            ahead.isNotNull()),
        _insight(
            "FORECAST_BEST_WEEK", "ALL", "QTY", b["qty"],
            F.concat(F.lit("Largest expected quantity: week "), b["wk"].cast("string"), F.lit(", about "),
                     units_text(b["qty"]), F.lit(" units")),
            F.concat(F.lit("Stock up ahead of week "), b["wk"].cast("string")),
            b.isNotNull()),
    ]


def insights(history: DataFrame, planned: DataFrame | None = None,
             promos: Iterable[str] = PROMOS) -> DataFrame:
    """All insight rows: promo effectiveness, best and worst week, forecast trend and peak.

    One aggregate over the past, one over the forecast. Groups without a
    forecast still get the historical insights.
    """
    promos = list(promos)
    agg = _history_aggregate(history, promos)
    if planned is None:
        return _unfold(agg, _history_rows(promos))
    week = F.struct(F.col(WEEK).alias("wk"), F.col("qty").alias("qty"))
    ahead = planned.groupBy("dept", GROUP).agg(
        F.avg("qty").alias("forecast_qty"),
        F.max_by(week, F.struct(F.col("qty"), -F.col(WEEK))).alias("ahead"))
    return _unfold(agg.join(ahead, ["dept", GROUP], "left"), _history_rows(promos) + _forecast_rows())
