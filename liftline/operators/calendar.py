"""Calendar operators.

Each returns one row with one week. `week()` turns that into a scalar column that
stays inside the plan; `week_window()` fetches the four bounds of a run as ints, so
that they reach the scans as literals. The calendar has one row per week, which
bounds every sort and array built from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import HISTORY_WEEKS, HORIZON_WEEKS, WEEK


def week(one_row: DataFrame) -> Column:
    """Scalar subquery over a one-row frame."""
    return one_row.scalar()


def last_week(panel: DataFrame) -> DataFrame:
    return panel.agg(F.max(WEEK).alias("week_end"))


def history_start(cal: DataFrame, end, n: int = HISTORY_WEEKS) -> DataFrame:
    """Earliest of the n latest distinct weeks before `end`."""
    latest = (cal.filter(F.col(WEEK) < end).select(WEEK).distinct()
              .orderBy(F.col(WEEK).desc()).limit(n))
    return latest.agg(F.min(WEEK).alias("week_start"))


def horizon_end(cal: DataFrame, end, n: int = HORIZON_WEEKS) -> DataFrame:
    """Latest of the n earliest distinct weeks after `end`."""
    ahead = (cal.filter(F.col(WEEK) > end).select(WEEK).distinct()
             .orderBy(F.col(WEEK).asc()).limit(n))
    return ahead.agg(F.max(WEEK).alias("forecast_end"))


def horizon_start(cal: DataFrame, end) -> DataFrame:
    return cal.filter(F.col(WEEK) > end).agg(F.min(WEEK).alias("forecast_start"))


@dataclass(frozen=True)
class WeekWindow:
    """First and last week of history and of the horizon."""

    start: int
    end: int
    forecast_start: int
    forecast_end: int


def week_window(cal: DataFrame, end: int | None = None, history: int = HISTORY_WEEKS,
                horizon: int = HORIZON_WEEKS) -> WeekWindow:
    """The bounds of a run whose last historical week is `end`.

    Without `end` the horizon takes the calendar's last weeks. One job on the
    calendar, returning one row of ints.
    """
    if end is None:
        last = last_week(cal).first()[0]
        end = history_start(cal, last, horizon).first()[0]
    row = history_start(cal, end, history).select(
        "week_start",
        week(horizon_start(cal, end)).alias("forecast_start"),
        week(horizon_end(cal, end, horizon)).alias("forecast_end")).first()
    return WeekWindow(row[0], end, row[1], row[2])


def calendar_slice(cal: DataFrame, lo, hi) -> DataFrame:
    return cal.filter(F.col(WEEK).between(lo, hi)).select(WEEK, "start_date", "end_date").distinct()


def week_array(cal: DataFrame) -> Column:
    """Sorted weeks of the calendar as one array column."""
    return cal.agg(F.array_sort(F.collect_set(WEEK))).scalar()
