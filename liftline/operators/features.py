"""Panel features: dense weeks, filled prices, lags, slots, cross-group promos.

All windows are keyed by department and group (and back-test origin, where a frame
has one). Such a series has at most one row per week, and a frame partitioned by
these keys keeps that partitioning through the whole chain.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse_quoted_list
from ..params import GROUP, LAGS, PROMOTIONS, SLOT_GATE, SLOTS, WEEK, keys_of, lag_name
from .calendar import week_array
from .clean import one_hot_page, round_depths


def by_group(frame: DataFrame) -> Window:
    return Window.partitionBy(*keys_of(frame.columns))


def by_week(frame: DataFrame) -> Window:
    return by_group(frame).orderBy(WEEK)


def densify(panel: DataFrame, cal: DataFrame, constants: Iterable[str] = ("dept",)) -> DataFrame:
    """One row per series and calendar week; weeks without sales are null.

    Each row repeats itself over the calendar weeks up to the series' next row
    (the first also over the weeks before it), so gaps are filled inside the
    series: no join of groups with weeks and no further shuffle. Two rows of one
    series and week are an error.
    """
    weeks = week_array(cal)
    index = (cal.agg(F.array_sort(F.collect_set(WEEK)).alias("weeks"))
             .select(F.posexplode("weeks").alias("pos", WEEK))
             .select(WEEK, (F.col("pos") + 1).alias("cal_idx")))
    # one row per calendar week: a side with a fixed bound
    placed = panel.join(F.broadcast(index), WEEK)
    keys = keys_of(panel.columns)
    w = Window.partitionBy(*keys).orderBy("cal_idx")
    following = F.lead("cal_idx").over(w)
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("cal_idx"))
    doubled = F.concat(F.lit("two rows of one series and week: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in (*keys, WEEK)]))
    last = F.when(following == F.col("cal_idx"), F.raise_error(doubled).cast("int")).otherwise(
        F.coalesce(following - 1, F.size(weeks)))
    keep = {*keys, WEEK, *constants}
    spread = (
        placed.withColumns({"span_from": first, "span_to": last})
        .withColumn("at", F.explode(F.sequence("span_from", "span_to")))
    )
    own = F.col("at") == F.col("cal_idx")
    return spread.select(*[
        F.element_at(weeks, F.col("at")).alias(c) if c == WEEK
        else F.col(c) if c in keep else F.when(own, F.col(c)).alias(c)
        for c in panel.columns
    ])


def fill_price_avg(panel: DataFrame, columns: Iterable[str] = ("regular_price", "live_price")) -> DataFrame:
    """A zero price becomes the mean of itself and the four rows before it."""
    frame = by_week(panel).rowsBetween(-4, 0)
    return panel.withColumns({
        c: F.when(F.col(c) == 0, F.avg(c).over(frame)).otherwise(F.col(c)) for c in columns})


def fill_price_mode(panel: DataFrame, columns: Iterable[str] = ("regular_price", "live_price"),
                    recursive: bool = False) -> DataFrame:
    """A zero price becomes the commonest non-zero price within four rows.

    Ties take the smallest price. `recursive` fills from left to right, so that
    filled prices count for later gaps.
    """
    if not recursive:
        frame = by_week(panel).rowsBetween(-4, 4)
        return panel.withColumns({
            c: F.when(F.col(c) == 0, F.coalesce(
                F.mode(F.when(F.col(c) != 0, F.col(c)), True).over(frame), F.lit(0.0)))
            .otherwise(F.col(c)) for c in columns})
    keys = keys_of(panel.columns)
    rows = panel.withColumn("fill_at", F.row_number().over(by_week(panel)))
    # one array per group, at most one element per calendar week
    filled = rows.groupBy(*keys).agg(*[
        F.transform(F.array_sort(F.collect_list(F.struct("fill_at", F.col(c).alias("p")))),
                    lambda x: x["p"]).alias(f"{c}_series") for c in columns])
    filled = filled.select(*keys, *[
        _fill_left_to_right(F.col(f"{c}_series")).alias(f"{c}_series") for c in columns])
    joined = rows.join(filled, keys)
    return joined.withColumns({
        c: F.element_at(f"{c}_series", F.col("fill_at")) for c in columns
    }).select(*panel.columns)


def _fill_left_to_right(prices: Column, reach: int = 4) -> Column:
    def commonest(near: Column) -> Column:
        ranked = F.array_sort(F.transform(
            F.array_distinct(near),
            lambda v: F.struct((-F.size(F.filter(near, lambda x: x == v))).alias("n"), v.alias("v"))))
        return F.when(F.size(near) == 0, F.lit(0.0)).otherwise(ranked[0]["v"])

    def step(done: Column, i: Column) -> Column:
        left = F.slice(done, F.greatest(F.size(done) - (reach - 1), F.lit(1)), F.lit(reach))
        right = F.slice(prices, i, F.lit(reach + 1))
        near = F.filter(F.concat(left, right), lambda x: x != 0)
        here = F.element_at(prices, i)
        return F.concat(done, F.array(F.when(here == 0, commonest(near)).otherwise(here)))

    return F.aggregate(F.sequence(F.lit(1), F.size(prices)), F.expr("cast(array() as array<double>)"), step)


def promo_lags(panel: DataFrame, promotions: Iterable[str] = PROMOTIONS,
               lags: Iterable[int] = LAGS) -> DataFrame:
    w = by_week(panel)
    return panel.withColumns({
        lag_name(p, k): F.lag(p, k).over(w) for k in lags for p in promotions})


def drop_head(panel: DataFrame, n: int = len(LAGS)) -> DataFrame:
    """Drop the first n weeks of every series."""
    return (panel.withColumn("head_rn", F.row_number().over(by_week(panel)))
            .filter(F.col("head_rn") > n).drop("head_rn"))


def week_index(panel: DataFrame) -> DataFrame:
    return panel.withColumn("t", F.row_number().over(by_week(panel)))


def week_slot(panel: DataFrame) -> DataFrame:
    """Slot 1..52 by row number, null for groups with too few rows for seasonality."""
    enough = F.count(F.lit(1)).over(by_group(panel)) >= SLOT_GATE
    return panel.withColumn(
        "slot", F.when(enough, F.pmod(F.row_number().over(by_week(panel)) - 1, F.lit(SLOTS)) + 1))


def slot_dummies(panel: DataFrame) -> DataFrame:
    """The 52 slot columns week_1..week_52, from `slot`."""
    return panel.withColumns({
        f"week_{i}": F.coalesce((F.col("slot") == i).cast("int"), F.lit(0)) for i in range(1, SLOTS + 1)})


def single_dept_groups(panel: DataFrame) -> DataFrame:
    """Groups that occur in exactly one department."""
    return (panel.groupBy(GROUP).agg(F.min("dept").alias("lo"), F.max("dept").alias("hi"))
            .filter(F.col("lo") == F.col("hi")).select(GROUP))


# --- fixed value: edges of one focus group that a task may hold ---
EDGES_PER_TASK = 10_000


def cross_features(panel: DataFrame, edges: DataFrame, kind: str,
                   promotions: Iterable[str] = PROMOTIONS,
                   edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Promo columns of each focus group on its target group's weeks, long.

    Rows (target_dept, target_group, yr_wk, focus_dept, focus_group, promo, feature,
    value); `feature` is <focus>_<promo>_<KIND>_PROMO. The panel joins the edges on
    the focus group before the promo list is exploded, so wide rows are shuffled
    once. A focus group with very many edges is split by target over several tasks,
    its few panel rows repeated for each. Edges and promos that are listed twice count
    once. For halo edges, focus groups found in several departments are left out.
    """
    promotions = list(promotions)
    edges = _with_departments(panel, edges)
    target = ["target_dept", "target_group"]
    # one row per edge, each promo once; a set holds no more than the known promos
    pairs = (edges.withColumn("promo", F.explode("promos")).filter(F.col("promo").isin(promotions))
             .groupBy("focus_dept", "focus_group", *target).agg(F.collect_set("promo").alias("promos")))
    focus = panel.select(F.col("dept").alias("focus_dept"), F.col(GROUP).alias("focus_group"), WEEK, *promotions)
    if kind == "halo":
        focus = focus.join(single_dept_groups(panel).withColumnRenamed(GROUP, "focus_group"), "focus_group", "left_semi")
    key = ["focus_dept", "focus_group"]
    # a focus group's edges in parts of bounded size: 1 part for all but the crowded ones
    pairs = pairs.withColumn("parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*key)) / edges_per_task).cast("int"))
    pairs = pairs.withColumn("part", F.pmod(F.hash(*target), F.col("parts")))
    parts = pairs.groupBy(*key).agg(F.max("parts").alias("n_parts"))
    focus = focus.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    value = F.coalesce(*[F.when(F.col("promo") == p, F.col(p).cast("double")) for p in promotions], F.lit(0.0))
    return (
        focus.drop("n_parts").join(pairs.drop("parts"), [*key, "part"])
        .withColumn("promo", F.explode("promos"))
        .select(*target, WEEK, *key, "promo", feature_name(kind).alias("feature"), value.alias("value"))
    )


def cross_dictionary(panel: DataFrame, edges: dict[str, DataFrame], promotions: Iterable[str] = PROMOTIONS) -> DataFrame:
    """All cross features, numbered from 0 within each target.

    `edges` maps kinds ("cann", "halo") to relation edges. Rows (target_dept,
    target_group, feature, kind, focus_dept, focus_group, promo, name), each feature
    once however often its edge is listed.
    """
    found = []
    for kind, listed in edges.items():
        rows = _with_departments(panel, listed).withColumn("promo", F.explode("promos")).filter(F.col("promo").isin(list(promotions)))
        if kind == "halo":
            rows = rows.join(single_dept_groups(panel).withColumnRenamed(GROUP, "focus_group"), "focus_group", "left_semi")
        found.append(rows.select("target_dept", "target_group", F.lit(kind).alias("kind"), "focus_dept", "focus_group", "promo",
                                 feature_name(kind).alias("name")))
    names = reduce(DataFrame.unionByName, found).distinct()
    order = Window.partitionBy("target_dept", "target_group").orderBy("kind", "focus_group", "focus_dept", "promo")
    return names.withColumn("feature", F.row_number().over(order) - 1)


def with_cross_features(panel: DataFrame, dictionary: DataFrame, promotions: Iterable[str] = PROMOTIONS,
                        edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """panel with `cross`: a map of feature number to value, without zeros, for every series and week.

    A focus group's promotions go to its targets' weeks together with the panel's
    own rows, in one shuffle by department and group. Weeks in which only a focus
    group sold become rows without measures, as densifying would make them. Two rows
    of one series and week are an error.
    """
    promotions = list(promotions)
    key = ["focus_dept", "focus_group"]
    # one row per target of a focus group; a set holds no more than the known promos
    pairs = dictionary.groupBy(*key, "target_dept", "target_group").agg(
        F.collect_set(F.struct("promo", "feature")).alias("features"))
    pairs = pairs.withColumn("parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*key)) / edges_per_task).cast("int"))
    pairs = pairs.withColumn("part", F.pmod(F.hash("target_dept", "target_group"), F.col("parts")))
    parts = pairs.groupBy(*key).agg(F.max("parts").alias("n_parts"))
    strength = [F.struct(F.lit(p).alias("promo"), F.col(p).cast("double").alias("value")) for p in promotions]
    focus = one_hot_page(round_depths(panel)).select(
        F.col("dept").alias("focus_dept"), F.col(GROUP).alias("focus_group"), WEEK,
        F.map_from_entries(F.filter(F.array(*strength), lambda s: s["value"] != 0)).alias("strength"))
    focus = focus.filter(F.size("strength") > 0).join(parts, key).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    brought = focus.drop("n_parts").join(pairs.drop("parts"), [*key, "part"]).withColumn("f", F.explode("features")).select(
        F.col("target_dept").alias("dept"), F.col("target_group").alias(GROUP), WEEK,
        F.col("f.feature").alias("feature"), F.try_element_at("strength", F.col("f.promo")).alias("value")).filter("value IS NOT NULL")

    keys = ["dept", GROUP]
    own = panel.select(*keys, WEEK, F.struct(*[c for c in panel.columns if c not in (*keys, WEEK)]).alias("own"))
    both = own.unionByName(brought, allowMissingColumns=True).repartition(*keys)
    weekly = both.groupBy(*keys, WEEK).agg(
        F.max("own").alias("own"), F.count("own").alias("n_own"),
        # at most one entry per feature of the target
        F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "value")))).alias("cross"))
    doubled = F.concat(F.lit("two rows of one series and week: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in (*keys, WEEK)]))
    known = F.max(F.when(F.col("n_own") > 1, F.raise_error(doubled).cast("int")).otherwise(F.col("n_own"))).over(Window.partitionBy(*keys))
    rows = weekly.withColumn("known", known).filter("known > 0")
    return rows.select(*[F.col(c) if c in (*keys, WEEK) else F.col(f"own.{c}").alias(c) for c in panel.columns], "cross")


def cross_long(table: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The non-zero cross features of a table as rows (dept, group_code, yr_wk, name, value)."""
    names = dictionary.select(F.col("target_dept").alias("dept"), F.col("target_group").alias(GROUP), "feature", "name")
    return table.select("dept", GROUP, WEEK, F.explode("cross").alias("feature", "value")).join(
        names, ["dept", GROUP, "feature"]).select("dept", GROUP, WEEK, "name", "value")


def feature_name(kind: str) -> Column:
    return F.concat_ws("_", "focus_group", "promo", F.lit(f"{kind.upper()}_PROMO"))


def _with_departments(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with promos as array and both departments, onto targets in the panel. An edge that names no department
    holds for every department in which the panel has the group."""
    if dict(edges.dtypes)["promos"] == "string":
        edges = edges.withColumn("promos", parse_quoted_list(F.col("promos")))
    groups = panel.select("dept", GROUP).distinct()
    for side in ("focus", "target"):
        known = groups.select(F.col("dept").alias(f"{side}_dept"), F.col(GROUP).alias(f"{side}_group"))
        keys = [c for c in known.columns if c in edges.columns]
        edges = edges.join(known, keys)
    return edges


def feature_matrix(features: DataFrame, target: str, names: Iterable[str]) -> DataFrame:
    """Wide view of one target's cross features, for an explicit list of names."""
    return (features.filter(F.col("target_group") == target)
            .groupBy("target_group", WEEK).pivot("feature", list(names)).agg(F.first("value")))


def lags_long(panel: DataFrame, promotions: Iterable[str] = PROMOTIONS,
              lags: Iterable[int] = LAGS, carry: Iterable[str] = ()) -> DataFrame:
    """Lag columns as rows (group, week, lag, value), missing lags as 0."""
    names = [lag_name(p, k) for k in lags for p in promotions]
    typed = panel.select("dept", GROUP, WEEK, *carry, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    return typed.unpivot(["dept", GROUP, WEEK, *carry], names, "lag", "value")


def _listed_lags(allowed: DataFrame) -> DataFrame:
    """(keys, lag): every listed lag once, by department too where the lists name it."""
    if dict(allowed.dtypes)["promos"] == "string":
        allowed = allowed.withColumn("promos", parse_quoted_list(F.col("promos")))
    names = {"focus_dept": "dept", "focus_group": GROUP}
    return allowed.select(*[F.col(c).alias(n) for c, n in names.items() if c in allowed.columns],
                          F.explode("promos").alias("lag")).distinct()


def keep_lags(long_lags: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lag rows listed for their group; groups without a list keep all lags.

    Names are matched exactly, by a join on group and lag.
    """
    listed = _listed_lags(allowed)
    keys = keys_of(listed.columns)
    with_list = listed.select(*keys).distinct().withColumn("has_list", F.lit(True))
    return (
        long_lags.join(with_list, keys, "left")
        .join(listed.withColumn("is_listed", F.lit(True)), [*keys, "lag"], "left")
        .filter(F.col("has_list").isNull() | F.col("is_listed"))
        .select(*long_lags.columns)
    )


def keep_lag_columns(panel: DataFrame, allowed: DataFrame) -> DataFrame:
    """Wide form of `keep_lags`: lags that are not listed for the group become null."""
    listed = _listed_lags(allowed)
    lagged = [c for c in panel.columns if "_lag_" in c]
    keys = keys_of(listed.columns)
    # one row per group, at most as many names as there are lag columns
    sets = listed.groupBy(*keys).agg(F.collect_set(F.when(F.col("lag").isin(lagged), F.col("lag"))).alias("allowed"))
    keep = lambda c: F.col("allowed").isNull() | F.array_contains("allowed", c)
    return panel.join(sets, keys, "left").withColumns({c: F.when(keep(c), F.col(c)) for c in lagged}).select(*panel.columns)


def drop_constant_features(long: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """Long feature rows whose feature takes more than one value in its series."""
    keys = [*keys_of(long.columns), "lag"] if keys is None else list(keys)
    varying = (long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
               .filter(F.col("lo") < F.col("hi")).select(*keys))
    return long.join(varying, keys, "left_semi")


def skip_empty(panel: DataFrame, measure: str = "modelled_qty") -> DataFrame:
    """Drop series whose measure is 0 in every week."""
    peak = F.max(F.abs(F.col(measure))).over(by_group(panel))
    return panel.withColumn("peak", peak).filter(F.col("peak") > 0).drop("peak")
