"""Forecast errors by rolling origins.

Each origin is a week. The model is fitted on the weeks up to the origin only and
forecasts the weeks after it, whose quantities are known. An origin is a key like
department and group, so all origins are one plan: a row is repeated for every
origin that may see it, and the windows of the model run within the origin.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio_or_null
from ..params import GROUP, HORIZON_WEEKS, PROMOS, WEEK, ModelParams
from .baseline import baseline_results
from .forecast import forecast
from .model_table import finish_table

# --- fixed values: origins of a back-test and the weeks between them ---
ORIGINS = 3
ORIGIN_STEP = 4
# --- end of fixed values ---


def origin_weeks(weeks: Iterable[int], horizon: int = HORIZON_WEEKS, origins: int = ORIGINS, step: int = ORIGIN_STEP) -> dict[int, int]:
    """Origin to the last week it forecasts, the latest first: the last `origins` weeks, `step` apart, that have a whole
    horizon of the given weeks after them."""
    weeks = sorted(set(weeks))
    last = [len(weeks) - 1 - horizon - step * i for i in range(origins)]
    return {weeks[i]: weeks[i + horizon] for i in last if i >= 0}


def rolling_forecasts(prepared: DataFrame, origins: dict[int, int], params: ModelParams = ModelParams(),
                      promos: Iterable[str] = PROMOS) -> DataFrame:
    """(origin, dept, group_code, yr_wk, forecast, actual) of the weeks after each origin.

    `prepared` are the rows of `model_table.prepared_rows`, in which no row depends
    on a later week.
    """
    spans = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(e).alias("until")) for o, e in origins.items()])
    seen = prepared.withColumn("origin", F.explode(F.transform(
        F.filter(spans, lambda s: F.col(WEEK) <= s["origin"]), lambda s: s["origin"])))
    ahead = prepared.withColumn("origin", F.explode(F.transform(
        F.filter(spans, lambda s: (F.col(WEEK) > s["origin"]) & (F.col(WEEK) <= s["until"])), lambda s: s["origin"])))
    history = baseline_results(finish_table(seen, params))
    planned = forecast(history, ahead, promos, carry=("modelled_qty",))
    return planned.select("origin", "dept", GROUP, WEEK, F.col("qty").alias("forecast"), F.col("carried_modelled_qty").alias("actual"))


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """(dept, group_code, n_forecasts, forecast_wmape, forecast_mape) over all origins and weeks.

    WMAPE is the sum of absolute errors over the sum of actuals; MAPE is over weeks with sales. Null without any.
    """
    error = F.abs(F.col("forecast") - F.col("actual"))
    return forecasts.groupBy("dept", GROUP).agg(
        F.count(F.lit(1)).alias("n_forecasts"),
        ratio_or_null(F.sum(error), F.sum("actual")).alias("forecast_wmape"),
        F.avg(F.when(F.col("actual") > 0, error / F.col("actual"))).alias("forecast_mape"))
