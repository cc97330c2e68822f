"""Holidays as weekly event columns.

A rule gives a holiday's day in any year, so days move as they should. Rules are
column expressions over a year; the calendar says which years there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import WEEK

# --- fixed values: holiday columns of the result frames, and their days -------------------------
# (month, day); (month, weekday, n): the n-th such weekday of the month; n: days after Easter Sunday
HOLIDAYS: dict[str, tuple | int] = {
    "canada_day": (7, 1),
    "commonwealth_day": (3, "Mon", 2),
    "christmas_day": (12, 25),
    "thanksgiving_day": (10, "Mon", 2),
    "groundhog_day": (2, 2),
    "labor_day": (9, "Mon", 1),
    "valentines_day": (2, 14),
    "national_aborginal_day": (6, 21),
    "st_patricks_day": (3, 17),
    "epiphany_day": (1, 6),
    "national_tartan_day": (4, 6),
    "remembrance_day": (11, 11),
    "hlthcr_ad_day": (10, 18),
    "vimy_ridge_day": (4, 9),
    "good_friday": -2,
    "new_years": (1, 1),
    "anniversary_of_the_statue_of_westminister": (12, 11),
    "halloween": (10, 31),
}
# --- end of fixed values --------------------------------------------------------------------------


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the golden number, the epact and the Sunday that follows."""
    golden, century = year % 19, _div(year, 100)
    shift = century - _div(century, 4) - _div(8 * century + 13, 25)
    epact = (19 * golden + shift + 15) % 30
    # the two latest full moons are moved one day back
    epact = epact - _div(epact, 28) * (1 - _div(epact, 28) * _div(F.lit(29) / (epact + 1), 1) * _div(21 - golden, 11))
    weekday = (year + _div(year, 4) + epact + 2 - century + _div(century, 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), epact - weekday)


def holiday_day(rule: tuple | int, year: Column) -> Column:
    """The day of a rule in a year."""
    if isinstance(rule, int):
        return F.date_add(easter(year), rule)
    if len(rule) == 2:
        return F.make_date(year, F.lit(rule[0]), F.lit(rule[1]))
    month, weekday, n = rule
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))


def holiday_dates(cal: DataFrame, holidays: dict[str, tuple | int] = HOLIDAYS) -> DataFrame:
    """(holiday, day) of every year that the calendar touches."""
    years = cal.select(F.explode(F.array(F.year("start_date"), F.year("end_date"))).alias("y")).distinct()
    days = F.array(*[F.struct(F.lit(name).alias("holiday"), holiday_day(rule, F.col("y")).alias("day")) for name, rule in holidays.items()])
    return years.select(F.inline(days))


def holiday_weeks(cal: DataFrame, dates: DataFrame | None = None, names: Iterable[str] = tuple(HOLIDAYS),
                  lead: int = 0, lag: int = 0) -> DataFrame:
    """One row per week: a 0/1 column per holiday, and with lead or lag also
    <holiday>_before_<k> and <holiday>_after_<k>, 1 in the k-th week before and after it.

    `dates` is a table (holiday, day), by default the rules above. Every size here is
    bounded by the calendar.
    """
    names = list(names)
    dates = holiday_dates(cal) if dates is None else dates
    days = cal.select(WEEK, F.explode(F.sequence("start_date", "end_date")).alias("day"))
    weeks = days.join(dates, "day", "left").groupBy(WEEK).agg(*[
        F.max((F.coalesce(F.col("holiday"), F.lit("")) == n).cast("int")).alias(n) for n in names])
    order = Window.orderBy(WEEK)  # one row per calendar week
    moved = {}
    for n in names:
        moved |= {f"{n}_before_{k}": F.lead(n, k, 0).over(order) for k in range(1, lead + 1)}
        moved |= {f"{n}_after_{k}": F.lag(n, k, 0).over(order) for k in range(1, lag + 1)}
    return weeks.withColumns(moved) if moved else weeks


def holiday_columns(names: Iterable[str] = tuple(HOLIDAYS), lead: int = 0, lag: int = 0) -> list[str]:
    """The columns that holiday_weeks gives."""
    return [c for n in names for c in (n, *(f"{n}_before_{k}" for k in range(1, lead + 1)), *(f"{n}_after_{k}" for k in range(1, lag + 1)))]
