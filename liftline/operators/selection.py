"""Choosing groups and combining frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import GROUP, keys_of


def groups_of_interest(on_promo: DataFrame, future: DataFrame, halo: DataFrame,
                       cann: DataFrame) -> DataFrame:
    """Distinct (dept, group): on promo now, planned, or a relation target."""
    targets = [e.select(F.col("target_dept").alias("dept"), F.col("target_group").alias(GROUP))
               for e in (halo, cann)]
    parts = [on_promo.select("dept", GROUP), future.select("dept", GROUP), *targets]
    return reduce(DataFrame.union, parts).distinct()


def sample_groups(panel: DataFrame, n: int = 5) -> DataFrame:
    """First n groups of every department: the fallback when none is chosen."""
    w = Window.partitionBy("dept").orderBy(GROUP)
    return (panel.select("dept", GROUP).distinct()
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn"))


def interest_or_sample(interest: DataFrame, panel: DataFrame, n: int = 5) -> DataFrame:
    """Groups of interest; departments that have none fall back to a sample."""
    chosen = interest.select("dept").distinct()
    return interest.select("dept", GROUP).union(
        sample_groups(panel, n).join(chosen, "dept", "left_anti"))


def keep_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the listed groups; by department too where both sides name it."""
    keys = keys_of(set(df.columns) & set(groups.columns))
    return df.join(groups.select(*keys).distinct(), keys, "left_semi")


def union_frames(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name on the schema of the first frame: missing as null, extra dropped."""
    def fit(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in first.schema.fields])

    return reduce(DataFrame.unionByName, [fit(d) for d in others], first)


def distinct_keep_first(df: DataFrame, *keys: str) -> DataFrame:
    """One whole row per key: the smallest by the remaining columns, in order."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*rest)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1).drop("rn")


def last_n_weeks(panel: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*keys_of(panel.columns)).orderBy(F.col("yr_wk").desc())
    return panel.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
