"""The whole job: which groups are of interest, their models, and the result frames.

All departments and groups are one plan. Frames that several results need are
computed once in the session's shared folder: the weekly panel (stored by department
and group, so nothing that starts from it is shuffled by them again), the chosen
groups, the prepared rows and the baseline results.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calendar import WeekWindow, calendar_slice
from ..operators.clean import on_promo_in_week, round_depths
from ..operators.features import cross_dictionary
from ..operators.holidays import HOLIDAYS, holiday_weeks
from ..operators.selection import groups_of_interest, interest_or_sample, keep_groups
from ..params import GROUP, WEEK, ModelParams
from ..sources.sink import keyed, shared, write_frames
from ..sources.tables import future_targets, scan_edges, scan_panel, stamp
from . import backtest, baseline, forecast, insights, model_table, regression

FRAMES = ("results", "forecast", "insights", "classes", "fit_log", "halo", "cann")


@dataclass(frozen=True)
class JobInputs:
    """Tables of a run.

    `panel` has a row per department, group and week, past and planned; quantities
    and sales of planned weeks are not read. `edges` has relation edges by kind,
    "cann" and "halo". `holidays` are (holiday, day), by default the library's rules.
    """

    panel: DataFrame
    cal: DataFrame
    edges: dict[str, DataFrame]
    allowed_lags: DataFrame | None = None
    holidays: DataFrame | None = None
    holiday_names: tuple[str, ...] = tuple(HOLIDAYS)
    params: ModelParams = field(default_factory=ModelParams)


def chosen_groups(history: DataFrame, targets: DataFrame, edges: dict[str, DataFrame], scorecard_wk: int) -> DataFrame:
    """Groups on promotion in the scorecard week, with a planned flyer, or targets of a relation; a department
    without any gets its first groups."""
    now = on_promo_in_week(history, scorecard_wk)
    return interest_or_sample(groups_of_interest(now, targets, edges["halo"], edges["cann"]), history).distinct()


def job_frames(inputs: JobInputs, window: WeekWindow, depts: Iterable[int] | None = None) -> dict[str, DataFrame]:
    """The result frames by name, stamped with the scorecard week.

    results: a row per group and week with measures, coefficients and contributions.
    forecast: planned weeks of the groups with a planned flyer. insights: rule-based
    findings, for every chosen group. classes: promotions by sign and significance.
    fit_log: fit quality and back-tested forecast errors. halo, cann: coefficients of
    the relations, from the same fit as the group's own.
    """
    params, names = inputs.params, list(inputs.holiday_names)
    weekly = keyed(scan_panel(inputs.panel, window.start, window.forecast_end, depts), ("dept", GROUP))
    past_weeks = calendar_slice(inputs.cal, window.start, window.end)
    history = scan_panel(weekly, window.start, window.end)
    plan = scan_panel(weekly, window.forecast_start, window.forecast_end).withColumns({"qty": F.lit(0.0), "sales": F.lit(0.0)})
    edges = {kind: scan_edges(e, depts, "target_dept") for kind, e in inputs.edges.items()}
    targets = shared(future_targets(plan, window.forecast_start, window.forecast_end))
    chosen = shared(chosen_groups(history, targets, edges, window.end))

    dictionary = cross_dictionary(history, edges)
    dictionary = shared(dictionary.join(chosen.select(F.col("dept").alias("target_dept"), F.col(GROUP).alias("target_group")),
                                        ["target_dept", "target_group"], "left_semi"))
    days = holiday_weeks(inputs.cal, inputs.holidays, names)
    prepared = shared(keep_groups(model_table.prepared_rows(
        history, past_weeks, inputs.allowed_lags, params, dictionary, days), chosen))
    table = shared(baseline.baseline_results(model_table.finish_table(prepared, params)))

    fit = shared(regression.joint_regression(table, dictionary, names))
    own = fit.filter(F.col("kind") == "own")
    ahead_weeks = calendar_slice(inputs.cal, window.forecast_start, window.forecast_end)
    planned = shared(forecast.forecast(table, model_table.clean_panel(round_depths(keep_groups(plan, targets)), ahead_weeks, params)))
    weeks = [r[WEEK] for r in past_weeks.select(WEEK).collect()]  # one row per calendar week
    errors = backtest.forecast_errors(backtest.rolling_forecasts(prepared, backtest.origin_weeks(weeks), params))
    frames = {
        "results": stamp(regression.model_results(table, own, names), window.end, is_forecast=0),
        "forecast": stamp(planned, window.end),
        "insights": stamp(insights.insights(table, planned), window.end),
        "classes": stamp(regression.insight_classes(own), window.end),
        "fit_log": stamp(baseline.fit_log(table, errors), window.end),
        "halo": stamp(regression.joint_relations(fit, "halo"), window.end),
        "cann": stamp(regression.joint_relations(fit, "cann"), window.end),
    }
    return {name: frames[name] for name in FRAMES}


def run_job(inputs: JobInputs, window: WeekWindow, root: str, depts: Iterable[int] | None = None,
            file_format: str = "parquet") -> DataFrame:
    """Write all frames below `root`, by department and scorecard week; (frame, rows), as the writing runs counted them."""
    rows = write_frames(job_frames(inputs, window, depts), root, file_format=file_format)
    return inputs.panel.sparkSession.createDataFrame(list(rows.items()), "frame string, rows long")
