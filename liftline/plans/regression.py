"""Promotion regression per group, with the promotions of related groups.

The model itself is this library's own definition: least squares of the
modelled quantity on slots, trend, promotions, holidays, lags and, in one fit
with them, the halo and cannibalisation features of the group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import lags_long
from ..operators.gram import least_squares, sparse_vector
from ..operators.regression import ols_coefficients
from ..params import GROUP, LAG_COLUMNS, PROMOTIONS, REGION, SLOTS, WEEK

# --- fixed values: significance, classes of the result frame, first number of the cross terms ---
SIGNIFICANT_T = 2.0
CLASSES = ("Positive_Significant", "Negative_Significant", "Positive_Insignificant",
           "Negative_Insignificant")
CROSS_TERMS = 1 << 16
# --- end of fixed values ---
FIT = ("coef", "std_error", "t_value", "n", "dof", "r2", "rss")


def own_terms(holidays: Iterable[str] = ()) -> list[str]:
    """A group's own terms in the order in which they enter: number i is the i-th name.

    Holidays come before slots: a day that falls into the same slot every year keeps
    its term, and the slot goes.
    """
    return ["intercept", *holidays, *[f"week_{i}" for i in range(1, SLOTS + 1)], "trend", *PROMOTIONS, *LAG_COLUMNS]


def joint_regression(table: DataFrame, dictionary: DataFrame | None = None, holidays: Iterable[str] = ()) -> DataFrame:
    """All coefficients of every group in one fit: (dept, group_code, kind, term, focus_dept, focus_group, promo, coef,
    std_error, t_value, n, dof, r2, rss).

    `kind` is "own", "cann" or "halo"; focus and promo are null for own terms. With a
    dictionary the table must carry `cross` (see `plans.model_table`).
    """
    names = own_terms(holidays)
    fixed = {"intercept": F.lit(1)} | {f"week_{i}": (F.col("slot") == i).cast("int") for i in range(1, SLOTS + 1)}
    cross = None if dictionary is None else F.transform(F.map_entries("cross"), lambda e: F.struct(
        (e["key"] + CROSS_TERMS).alias("term"), e["value"].alias("value")))
    vector = sparse_vector([(F.lit(i), fixed[n] if n in fixed else F.col(n)) for i, n in enumerate(names)], cross)
    keys = ["dept", GROUP]
    fit = least_squares(table.select(*keys, "modelled_qty", vector.alias("terms")), keys, "terms", "modelled_qty")
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("term"))
    columns = [*keys, "kind", "term", "focus_dept", "focus_group", "promo", *FIT]
    own = fit.filter(F.col("term") < CROSS_TERMS).select(
        *keys, F.lit("own").alias("kind"), name.alias("term"), F.lit(None).cast("int").alias("focus_dept"),
        F.lit(None).cast("string").alias("focus_group"), F.lit(None).cast("string").alias("promo"), *FIT)
    if dictionary is None:
        return own.select(*columns)
    features = dictionary.select(F.col("target_dept").alias("dept"), F.col("target_group").alias(GROUP),
                                 (F.col("feature") + CROSS_TERMS).alias("term"), "kind", "focus_dept", "focus_group", "promo", "name")
    named = fit.join(features, [*keys, "term"], "left")
    return named.select(
        *keys, F.coalesce("kind", F.lit("own")).alias("kind"), F.coalesce("name", name).alias("term"),
        "focus_dept", "focus_group", "promo", *FIT)


def promo_regression(table: DataFrame, holidays: Iterable[str] = ()) -> DataFrame:
    """Coefficients without related groups: (dept, group_code, term, coef, std_error, t_value, n, dof, r2, rss)."""
    return joint_regression(table, None, holidays).select("dept", GROUP, "term", *FIT)


def joint_relations(fit: DataFrame, kind: str) -> DataFrame:
    """One row per edge of a kind: target, focus, focus department and a <promo>_focus_coef column per promotion."""
    wide = fit.filter(F.col("kind") == kind).groupBy("dept", GROUP, "focus_group", "focus_dept").pivot(
        "promo", list(PROMOTIONS)).agg(F.first("coef"))
    return wide.select("dept", GROUP, "focus_group", "focus_dept", *[F.col(p).alias(f"{p}_focus_coef") for p in PROMOTIONS])


def coefficient_classes(coefficients: DataFrame, terms: Iterable[str] = PROMOTIONS) -> DataFrame:
    """Promotions of each group by sign and significance, as comma lists."""
    kind = F.concat(
        F.when(F.col("coef") >= 0, "Positive").otherwise("Negative"),
        F.when(F.abs("t_value") >= SIGNIFICANT_T, "_Significant").otherwise("_Insignificant"))
    rows = coefficients.filter(F.col("term").isin(list(terms))).withColumn("kind", kind)
    listed = {c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("term")))), ", ")
              for c in CLASSES}
    return rows.groupBy("dept", GROUP).agg(*[e.alias(c) for c, e in listed.items()])


def insight_classes(coefficients: DataFrame) -> DataFrame:
    """The class frame of 15 columns: group, region, a coefficient per promotion, and the promotions of each class."""
    wide = wide_coefficients(coefficients, PROMOTIONS)
    classes = coefficient_classes(coefficients)
    return wide.join(classes, ["dept", GROUP], "left").select(
        "dept", GROUP, F.lit(REGION).alias("region"), *[F.coalesce(f"{p}_coef", F.lit(0.0)).alias(p) for p in PROMOTIONS],
        *[F.coalesce(c, F.lit("")).alias(c) for c in CLASSES])


def lag_contributions(table: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Coefficient times value of every lag: (dept, group_code, yr_wk, lag, contribution)."""
    coef = coefficients.select("dept", GROUP, F.col("term").alias("lag"), "coef")
    long = lags_long(table).filter(F.col("value") != 0)
    return long.join(coef, ["dept", GROUP, "lag"]).select(
        "dept", GROUP, WEEK, "lag", (F.col("coef") * F.col("value")).alias("contribution"))


def wide_coefficients(coefficients: DataFrame, terms: Iterable[str]) -> DataFrame:
    """One row per group, a <term>_coef column for each listed term."""
    terms = list(terms)
    wide = coefficients.groupBy("dept", GROUP).pivot("term", terms).agg(F.first("coef"))
    return wide.select("dept", GROUP, *[F.col(t).alias(f"{t}_coef") for t in terms])


def model_results(results: DataFrame, coefficients: DataFrame, holidays: Iterable[str] = ()) -> DataFrame:
    """Wide result frame: measures, every coefficient, and the contribution of every lag.

    One row per group and week; terms the group's fit left out are 0. The
    coefficients are pivoted over a fixed list of names.
    """
    lags = list(LAG_COLUMNS)
    terms = [*PROMOTIONS, *[f"week_{i}" for i in range(1, SLOTS + 1)], *holidays, *lags, "intercept"]
    wide = wide_coefficients(coefficients, terms)
    measures = ["dept", GROUP, WEEK, "qty", "modelled_qty", "baseline_qty", "total_qty", "baseline_sales",
                "total_sales", "lift_sales", "lift_share", "trend", "regular_price", "region", "fitted"]
    filled = [F.coalesce(f"{t}_coef", F.lit(0.0)).alias(f"{t}_coef") for t in terms]
    shares = [(F.coalesce(f"{c}_coef", F.lit(0.0)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
              .alias(f"{c}_contri") for c in lags]
    return results.join(wide, ["dept", GROUP]).select(*measures, *filled, *shares)


def relation_coefficients(table: DataFrame, features: DataFrame,
                          measure: str = "modelled_qty") -> DataFrame:
    """Effect of each focus promotion on its target group, edge by edge.

    Least squares of the target's detrended quantity on the promotions of one
    focus group. A task holds one edge, weeks x promotions, however many edges a
    target has.
    """
    edge = ["target_dept", "target_group", "focus_dept", "focus_group"]
    base = table.select(F.col("dept").alias("target_dept"), F.col(GROUP).alias("target_group"), WEEK,
                        (F.col(measure) - F.col("trend")).alias("y"))
    rows = features.join(base, ["target_dept", "target_group", WEEK]).groupBy(*edge, WEEK).agg(
        F.first("y").alias("y"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("promo", "value"))))
        .alias("strength"))
    wide = rows.select(*edge, WEEK, "y", *[
        F.coalesce(F.element_at("strength", p), F.lit(0.0)).alias(p) for p in PROMOTIONS])
    fit = ols_coefficients(wide, "y", PROMOTIONS, edge, WEEK)
    return fit.filter(F.col("term") != "intercept").select(*edge, F.col("term").alias("promo"), "coef")


def wide_relation_coefficients(coefficients: DataFrame) -> DataFrame:
    """One row per edge: a <promo>_focus_coef column per promotion."""
    wide = coefficients.groupBy("target_dept", "target_group", "focus_dept", "focus_group").pivot(
        "promo", list(PROMOTIONS)).agg(F.first("coef"))
    return wide.select(
        F.col("target_dept").alias("dept"), F.col("target_group").alias(GROUP), "focus_group", "focus_dept",
        *[F.col(p).alias(f"{p}_focus_coef") for p in PROMOTIONS])
