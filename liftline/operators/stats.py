"""Profiles, associations and report counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import ratio_or_null
from ..params import GROUP, WEEK


def profile_by_upc(panel: DataFrame) -> DataFrame:
    """Distinct weeks, distinct stores and rows per product.

    Spark counts the distinct pairs first, spread by (product, week) and
    (product, store), so one large product does not load one task.
    """
    return panel.groupBy("upc").agg(
        F.count_distinct(WEEK).alias("n_weeks"),
        F.count_distinct("store").alias("n_stores"),
        F.count(F.lit(1)).alias("n_rows"))


def row_counts(raw: DataFrame, clean_condition) -> DataFrame:
    """Rows before and after cleaning, in one pass over the raw rows."""
    return raw.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(clean_condition, 1)).alias("rows_after"))


def counted_cleaning(raw: DataFrame, clean_condition: Column) -> tuple[DataFrame, Observation]:
    """The clean rows, and an observation that holds rows_before and rows_after once a job has run over them: counts for
    a report without a pass of their own."""
    seen = Observation(f"cleaning_{uuid.uuid4().hex}")
    kept = F.coalesce(clean_condition, F.lit(False))
    counted = raw.observe(seen, F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"))
    return counted.filter(kept), seen


def mode_nonzero(df: DataFrame, keys: Iterable[str], column: str) -> DataFrame:
    """Commonest non-zero value per key, the smallest on a tie; 0 where all are 0."""
    value = F.when(F.col(column) != 0, F.col(column))
    counts = df.select(*keys, value.alias("v")).groupBy(*keys, "v").agg(F.count("v").alias("n"))
    # counts are combined before the choice, so no group is held in memory whole
    best = F.max_by("v", F.struct(F.col("n"), -F.col("v")))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(0.0)).alias("mode_value"))


def scoreboard(results: DataFrame, planned: DataFrame, found: DataFrame) -> DataFrame:
    """Result rows and groups, forecast rows and insight rows per department and overall.

    `dept` is null in the overall row.
    """
    tagged = [
        df.select("dept", F.lit(kind).alias("kind"), GROUP)
        for kind, df in (("result", results), ("forecast", planned), ("insight", found))]
    per_group = reduce(DataFrame.union, tagged).groupBy("dept", GROUP).agg(*[
        F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("result", "forecast", "insight")])
    return per_group.rollup("dept").agg(
        F.sum("result").alias("result_rows"),
        F.count_distinct(F.when(F.col("result") > 0, F.col(GROUP))).alias("groups"),
        F.sum("forecast").alias("forecast_rows"),
        F.sum("insight").alias("insight_rows"))


def partition_skew(df: DataFrame, n_partitions: int | None = None, warn_above: float = 10.0) -> DataFrame:
    """Partitions, least, most and mean rows, most/mean.

    Empty partitions leave no rows to count; pass the number of partitions where
    it is known to include them.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("pid")).count()
    agg = sizes.agg(F.count(F.lit(1)).alias("filled"), F.min("count").alias("lo"),
                    F.max("count").alias("max_rows"), F.sum("count").alias("total"))
    total = F.lit(n_partitions) if n_partitions is not None else F.col("filled")
    staged = agg.withColumns({
        "partitions": total.cast("bigint"),
        "min_rows": F.when(total > F.col("filled"), F.lit(0)).otherwise(F.col("lo")),
    }).withColumn("mean_rows", ratio_or_null(F.col("total"), F.col("partitions")))
    staged = staged.withColumn("skew", ratio_or_null(F.col("max_rows"), F.col("mean_rows")))
    return staged.select("partitions", "min_rows", "max_rows", "mean_rows", "skew",
                         (F.col("skew") > warn_above).alias("skewed"))


def association_matrix(df: DataFrame, numeric: Iterable[str], categorical: Iterable[str]) -> DataFrame:
    """Association of every column pair, long: (left, right, kind, value).

    Two numbers: Pearson, over the rows where both are known. Number and category:
    correlation ratio. Two categories: Cramer's V without continuity correction.
    Pairs are ordered as the columns are listed, numbers first. Pairs with a constant
    side give null.

    One pass: rows are summed by grouping sets, one for the whole table, one per
    category and one per pair of categories. The cells carry counts, means, variances
    and covariances, which combine, and all that follows works on cells.
    """
    numeric, categorical = list(numeric), list(categorical)
    number_pairs, category_pairs = list(combinations(numeric, 2)), list(combinations(categorical, 2))
    sets = [(), *[(c,) for c in categorical], *category_pairs]

    def mark(chosen: tuple[str, ...]) -> int:
        """The grouping id of a set: a bit for each category that is not in it."""
        return sum(1 << i for i, c in enumerate(reversed(categorical)) if c not in chosen)

    moments = [F.count(F.lit(1)).cast("double").alias("n")]
    for c in numeric:
        moments += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    for a, b in number_pairs:
        moments.append(F.covar_pop(a, b).alias(f"cov_{a}_{b}"))
        moments += [F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c))).alias(f"sd_{a}_{b}_{c}") for c, other in ((a, b), (b, a))]
    if categorical:
        cells = df.groupingSets([list(s) for s in sets], *categorical).agg(F.grouping_id().alias("set"), *moments)
    else:
        cells = df.agg(*moments).withColumn("set", F.lit(0))
    chosen = F.col("set")
    known = reduce(lambda x, y: x | y, [
        (chosen == mark(s)) & reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in s], F.lit(True)) for s in sets])
    side = lambda i: F.coalesce(F.lit(None).cast("string"), *[
        F.when(chosen == mark(s), F.col(s[i]).cast("string")) for s in category_pairs])
    cells = cells.filter(known).withColumns({"a": side(0), "b": side(1)})
    by_a, by_b = Window.partitionBy("set", "a"), Window.partitionBy("set", "b")
    cells = cells.withColumns({
        "n_a": F.sum("n").over(by_a), "n_b": F.sum("n").over(by_b),
        "first_a": F.row_number().over(by_a.orderBy("b")) == 1, "first_b": F.row_number().over(by_b.orderBy("a")) == 1})
    # chi2 / n = sum(n_ab^2 / (n_a n_b)) - 1 over the cells that occur
    sums = [(F.sum(F.col("n") * F.col("n") / (F.col("n_a") * F.col("n_b"))) - 1).alias("phi2"),
            F.least(F.count_if("first_a"), F.count_if("first_b")).alias("levels")]
    for c in numeric:
        n, m = F.col(f"n_{c}"), F.col(f"m_{c}")
        sums += [F.sum(n).alias(f"n_{c}"), F.sum(n * F.col(f"v_{c}")).alias(f"within_{c}"),
                 F.sum(n * m).alias(f"sum_{c}"), F.sum(n * m * m).alias(f"square_{c}")]
    # the whole table is one cell
    sums += [F.max(c).alias(c) for c in cells.columns if c.startswith(("cov_", "sd_"))]
    whole = cells.groupBy("set").agg(*sums)

    def row(left: str, right: str, kind: str, value: Column) -> Column:
        return F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(kind).alias("kind"), value.alias("value"))

    def eta(c: str) -> Column:
        """sqrt(SS between / SS total)."""
        between = F.col(f"square_{c}") - F.col(f"sum_{c}") * ratio_or_null(F.col(f"sum_{c}"), F.col(f"n_{c}"))
        between = F.greatest(between, F.lit(0.0))
        return F.sqrt(ratio_or_null(between, between + F.col(f"within_{c}")))

    rows = {(): [row(a, b, "pearson", ratio_or_null(F.col(f"cov_{a}_{b}"), F.col(f"sd_{a}_{b}_{a}") * F.col(f"sd_{a}_{b}_{b}")))
                 for a, b in number_pairs]}
    rows |= {(c,): [row(n, c, "correlation_ratio", eta(n)) for n in numeric] for c in categorical}
    rows |= {s: [row(*s, "cramers_v", F.sqrt(ratio_or_null(F.greatest("phi2", F.lit(0.0)), F.col("levels") - 1)))] for s in category_pairs}
    listed = reduce(lambda e, s: F.when(chosen == mark(s), F.array(*rows[s])).otherwise(e), [s for s in rows if rows[s]],
                    F.lit(None).cast("array<struct<left:string,right:string,kind:string,value:double>>"))
    return whole.select(F.inline(listed))
