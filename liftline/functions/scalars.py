"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EPSILON, METRIC_DECIMALS

__all__ = [
    "active_promos", "any_nonzero", "any_positive", "clamp_nonneg", "clean_name",
    "half_up", "in_weeks", "metric_round", "multiplier",
    "parse_quoted_list", "percent_text", "promo_class", "quoted_list",
    "ratio_or_null", "raw_multiplier", "safe_log", "to_number", "units_text",
]


def safe_log(numerator: Column, denominator: Column) -> Column:
    """ln(numerator / denominator), both floored at EPSILON; null in, null out."""
    floor = F.lit(EPSILON)
    # greatest() skips nulls, so the null test must come first
    known = numerator.isNotNull() & denominator.isNotNull()
    return F.when(known, F.ln(F.greatest(numerator, floor) / F.greatest(denominator, floor)))


def metric_round(value: Column) -> Column:
    return F.round(value, METRIC_DECIMALS)


def half_up(numerator: Column, denominator: Column) -> Column:
    """Exact integer division rounded half up, for non-negative bigints."""
    return F.when(
        denominator > 0,
        F.call_function("div", 2 * numerator + denominator, 2 * denominator),
    )


def raw_multiplier(lift: Column, price_ratio: Column, elasticity: Column) -> Column:
    """lift / price_ratio ** elasticity; null when the power is unusable."""
    expected = F.pow(price_ratio, elasticity)
    usable = (expected > EPSILON) & (expected < F.lit(float("inf")))
    return F.when(usable, lift / expected)


def multiplier(lift: Column, price_ratio: Column, elasticity: Column) -> Column:
    """The raw multiplier, at least 1; null when it is null."""
    raw = raw_multiplier(lift, price_ratio, elasticity)
    return F.when(raw.isNotNull(), F.greatest(F.lit(1.0), raw))


def promo_class(instore: Column, flyer: Column, cpp: Column) -> Column:
    """Five promo classes; any other or unknown combination is Other_Promo."""
    on = instore == 1
    return (
        F.when(instore == 0, "No_Promo")
        .when(on & (flyer == 0) & (cpp == 0), "Instore_Only")
        .when(on & (flyer == 1) & (cpp == 0), "Instore_Flyer")
        .when(on & (flyer == 0) & (cpp == 1), "Instore_CPP")
        .when(on & (flyer == 1) & (cpp == 1), "Instore_Flyer_CPP")
        .otherwise("Other_Promo")
    )


def to_number(col: Column) -> Column:
    """Text or number to double; bad text and NaN become null."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def clamp_nonneg(col: Column) -> Column:
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def any_nonzero(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c != 0, F.lit(False)) for c in cols])


def any_positive(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c > 0, F.lit(False)) for c in cols])


def active_promos(promos: Iterable[str]) -> Column:
    """Comma list of the promos above zero in the row, or 'No promotions'."""
    listed = F.concat_ws(", ", *[F.when(F.col(p) > 0, F.lit(p)) for p in promos])
    return F.when(listed == "", "No promotions").otherwise(listed)


def in_weeks(week: Column, weeks: Iterable[int]) -> Column:
    weeks = list(weeks)
    return week.isin(weeks) if weeks else F.lit(False)


def parse_quoted_list(text: Column) -> Column:
    """Text like 'A', 'B' (quotes included) to array<string>; blanks are dropped."""
    bare = F.split(F.replace(text, F.lit("'"), F.lit("")), ",")
    return F.filter(F.transform(bare, lambda x: F.trim(x)), lambda x: x != "")


def quoted_list(names: Column) -> Column:
    """array<string> to text like 'A', 'B', sorted by name."""
    quoted = F.transform(F.array_sort(names), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.array_join(quoted, ", ")


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f%%", 100 * value)


def units_text(value: Column) -> Column:
    return F.format_string("%.0f", value)


def clean_name(name: str, table_prefix: str | None = None) -> str:
    """Column name without its table prefix, dots as underscores, lower case."""
    if table_prefix and name.lower().startswith(table_prefix.lower() + "."):
        name = name[len(table_prefix) + 1:]
    return name.replace(".", "_").lower()
