"""Modelling table for all groups: one lineage, one shuffle on department and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import (
    clamp_measures, default_region, one_hot_page, page_location_text, round_depths, zero_fill,
)
from ..operators.features import (
    densify, drop_head, fill_price_avg, fill_price_mode, keep_lag_columns, promo_lags, week_slot, with_cross_features,
)
from ..operators.trend import linear_trend, repair_anomalies
from ..params import KEYS, WEEK, ModelParams


def clean_panel(panel: DataFrame, cal: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Dense, zero-filled weeks with filled prices, clamped measures and page flags."""
    dense = densify(page_location_text(default_region(panel)), cal, constants=("dept", "region"))
    dense = zero_fill(dense)
    priced = fill_price_mode(dense) if params.price_fill == "mode" else fill_price_avg(dense)
    return one_hot_page(clamp_measures(priced))


def model_table(panel: DataFrame, cal: DataFrame, allowed_lags: DataFrame | None = None,
                params: ModelParams = ModelParams(), dictionary: DataFrame | None = None,
                holidays: DataFrame | None = None) -> DataFrame:
    """Lags, slots, trend and repaired quantities on the clean panel.

    With a dictionary of cross features (`operators.features.cross_dictionary`) each
    row carries `cross`, the promotions of related groups by feature number. With
    weekly holiday columns (`operators.holidays.holiday_weeks`) each row carries them.
    """
    return finish_table(prepared_rows(panel, cal, allowed_lags, params, dictionary, holidays), params)


def prepared_rows(panel: DataFrame, cal: DataFrame, allowed_lags: DataFrame | None = None,
                  params: ModelParams = ModelParams(), dictionary: DataFrame | None = None,
                  holidays: DataFrame | None = None) -> DataFrame:
    """The part of the modelling table that looks at no later week: clean rows with lags, without the first weeks."""
    # no repartition: the first window shuffles by the keys, unless the panel is stored by them
    rows = panel if dictionary is None else with_cross_features(panel, dictionary)
    rows = round_depths(rows.withColumn("modelled_qty", F.col("qty")))
    rows = promo_lags(clean_panel(rows, cal, params))
    if dictionary is not None:
        rows = rows.withColumn("cross", F.coalesce("cross", F.create_map().cast("map<int,double>")))
    if holidays is not None:  # one row per calendar week: a side with a fixed bound
        rows = rows.join(F.broadcast(holidays), WEEK)
    if allowed_lags is not None:
        rows = keep_lag_columns(rows, allowed_lags)
    return drop_head(rows, params.head)


def finish_table(rows: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Slots, trend and repaired quantities of prepared rows."""
    rows = linear_trend(week_slot(rows))
    return zero_fill(repair_anomalies(rows, params.anomaly), [
        c for c, t in rows.dtypes if t in ("double", "int", "bigint") and c not in {*KEYS, WEEK, "slot"}])
