"""Input schemas and output column contracts."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_PANEL = T.StructType([
    T.StructField("upc", T.StringType()),
    T.StructField("store", T.StringType()),
    T.StructField("yr_wk", T.IntegerType()),
    T.StructField("regular_price", T.StringType()),
    T.StructField("retail_price", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("sales", T.StringType()),
    T.StructField("instore_promo", T.IntegerType()),
    T.StructField("flyer", T.IntegerType()),
    T.StructField("cpp", T.IntegerType()),
])

METRICS = T.StructType([
    T.StructField("upc", T.StringType()),
    T.StructField("store", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("weeks", T.IntegerType()),
])

INSIGHTS = T.StructType([
    T.StructField("group_code", T.StringType()),
    T.StructField("dept", T.IntegerType()),
    T.StructField("insight_type", T.StringType()),
    T.StructField("promo_type", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("analysis", T.StringType()),
    T.StructField("recommendation", T.StringType()),
])

FIT_LOG = T.StructType([
    T.StructField("group_code", T.StringType()),
    T.StructField("dept", T.IntegerType()),
    T.StructField("region", T.StringType()),
    T.StructField("volume_status", T.StringType()),
    T.StructField("sparsity_status", T.StringType()),
    T.StructField("n_weeks", T.LongType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()),
    T.StructField("f_statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("mape", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("trend_rmse", T.DoubleType()),
    T.StructField("forecast_wmape", T.DoubleType()),
    T.StructField("forecast_mape", T.DoubleType()),
])

PULL_FORWARD = T.StructType([
    T.StructField("focus_group", T.StringType()),
    T.StructField("correlation_level", T.DoubleType()),
    T.StructField("pf_promotions", T.StringType()),
    T.StructField("focus_dept", T.IntegerType()),
])
