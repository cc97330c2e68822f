"""Price elasticity and promotion multipliers for every product x store series.

One shuffle on the series keys serves the whole plan: block windows, block
aggregates, the price fold and the reference look-ups. A series has at most one
row per week, which bounds every array and window below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metric_round, raw_multiplier, safe_log
from ..operators.clean import drop_incomplete, drop_negative, effective_price, with_promo_type
from ..params import (
    EPSILON, INSTORE_ONLY, IQR_FACTOR, MIN_BLOCK_WEEKS, MULTIPLIERS, NO_PROMO, PRICE_SMOOTHING,
    PRICE_SPIKE, SERIES, WEEK,
)

BLOCK = (*SERIES, "block_id")


def clean_series(panel: DataFrame) -> DataFrame:
    return with_promo_type(effective_price(drop_negative(drop_incomplete(panel))))


def change_flag(rows: DataFrame) -> DataFrame:
    """True on a series' first row, a new promo class, or a new unpromoted price."""
    w = Window.partitionBy(*SERIES).orderBy(WEEK)
    prev = F.lag(F.struct("promo_type", "regular_price")).over(w)
    new_type = ~F.col("promo_type").eqNullSafe(prev["promo_type"])
    new_price = (F.col("promo_type") == NO_PROMO) & ~F.col("regular_price").eqNullSafe(prev["regular_price"])
    return rows.withColumn("changed", prev.isNull() | new_type | new_price)


def with_blocks(rows: DataFrame) -> DataFrame:
    """Number the blocks of each series 1, 2, ... in week order."""
    running = Window.partitionBy(*SERIES).orderBy(WEEK).rowsBetween(Window.unboundedPreceding, 0)
    return change_flag(rows).withColumn(
        "block_id", F.sum(F.col("changed").cast("int")).over(running).cast("int")).drop("changed")


def iqr_bounds(rows: DataFrame) -> DataFrame:
    """Unit bounds lo, hi of each row's block."""
    block = Window.partitionBy(*BLOCK)
    q = F.percentile("units", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(block)
    staged = rows.withColumns({
        "q": q,
        "n": F.count("units").over(block),
        "least": F.min("units").over(block),
        "most": F.max("units").over(block),
    })
    q1, mid, q3 = (F.col("q")[i] for i in range(3))
    iqr = q3 - q1

    def bound(sign: int, extreme: str, quartile: Column) -> Column:
        return (
            F.when(F.col("n") == 0, F.lit(sign * float("inf")))
            .when(F.col("n") < 4, F.col(extreme) + sign * EPSILON)
            .when(iqr == 0, mid + sign * EPSILON)
            .otherwise(quartile + sign * IQR_FACTOR * iqr)
        )

    return staged.withColumns({"lo": bound(-1, "least", q1), "hi": bound(1, "most", q3)}).drop(
        "q", "n", "least", "most")


def block_stats(rows: DataFrame) -> DataFrame:
    """One row per block: class, weeks, median regular price, means inside the unit bounds."""
    inside = F.col("units").between(F.col("lo"), F.col("hi"))
    return iqr_bounds(rows).groupBy(*BLOCK).agg(
        F.first("promo_type").alias("promo_type"),
        F.min(WEEK).alias("start_wk"),
        F.max(WEEK).alias("end_wk"),
        F.median("regular_price").alias("regular_price"),
        F.avg(F.when(inside, F.col("units"))).alias("avg_units"),
        F.avg(F.when(inside, F.col("retail_price"))).alias("avg_retail"),
        F.count(F.when(inside, 1)).cast("int").alias("kept_weeks"),
        F.count(F.lit(1)).cast("int").alias("weeks"),
    )


def smooth_regular_price(blocks: DataFrame) -> DataFrame:
    """Carry the regular price over the unpromoted blocks of a series.

    A jump above 50 % keeps the carried price (regular and retail), a change up
    to 5 % counts as none, anything else is adopted. Adds `price` and
    `avg_price`. The state is the last accepted price, so the blocks of a series
    are folded in order.
    """
    fields = [c for c in blocks.columns if c not in SERIES]
    ordered = blocks.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("block_id", *[c for c in fields if c != "block_id"])))
        .alias("blocks"))
    start = F.struct(
        F.lit(None).cast("double").alias("carried"),
        F.expr("cast(array() as array<struct<price: double, spiked: boolean>>)").alias("out"))

    def step(state: Column, block: Column) -> Column:
        carried, price = state["carried"], block["regular_price"]
        comparable = (block["promo_type"] == NO_PROMO) & (carried > EPSILON)
        change = F.when(comparable, F.abs(price - carried) / carried)
        spiked = F.coalesce(change > PRICE_SPIKE, F.lit(False))
        held = spiked | F.coalesce(change <= PRICE_SMOOTHING, F.lit(False))
        processed = F.when(held, carried).otherwise(price)
        carry = F.when(block["promo_type"] == NO_PROMO, F.coalesce(processed, carried)).otherwise(carried)
        return F.struct(
            carry.alias("carried"),
            F.concat(state["out"], F.array(F.struct(processed.alias("price"), spiked.alias("spiked"))))
            .alias("out"))

    folded = ordered.select(*SERIES, "blocks", F.aggregate("blocks", start, step)["out"].alias("prices"))
    rows = folded.select(*SERIES, F.inline(F.arrays_zip("blocks", "prices")))
    rows = rows.select(*SERIES, "blocks.*", "prices.price", "prices.spiked")
    return rows.withColumn(
        "avg_price", F.when(F.col("spiked"), F.col("price")).otherwise(F.col("avg_retail")))


def block_table(panel: DataFrame) -> DataFrame:
    """Clean panel rows to blocks with processed prices."""
    return smooth_regular_price(block_stats(with_blocks(panel)))


def _state() -> Column:
    return F.struct("block_id", "promo_type", "price", "avg_units", "kept_weeks", "weeks")


def prev_block(blocks: DataFrame) -> DataFrame:
    """Add `prev`: the block just before in the series."""
    w = Window.partitionBy(*SERIES).orderBy("block_id")
    return blocks.withColumn("prev", F.lag(_state()).over(w))


def last_regular_block(blocks: DataFrame) -> DataFrame:
    """Add `ref`: the nearest earlier unpromoted block, however far back."""
    w = Window.partitionBy(*SERIES).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(
        "ref", F.last(F.when(F.col("promo_type") == NO_PROMO, _state()), ignorenulls=True).over(w))


def _elasticity(price: Column, units: Column, base_price: Column, base_units: Column) -> Column:
    """d ln units / d ln price where the price moved and the result is negative."""
    d_price, d_units = safe_log(price, base_price), safe_log(units, base_units)
    value = F.when(F.abs(d_price) > EPSILON, d_units / d_price)
    return F.when(value < 0, value)


def _enough(other: str) -> Column:
    return (F.col("kept_weeks") >= MIN_BLOCK_WEEKS) & (F.col(other)["kept_weeks"] >= MIN_BLOCK_WEEKS)


def with_regular_elasticity(blocks: DataFrame) -> DataFrame:
    """Add `e_regular` for adjacent unpromoted blocks at different processed prices."""
    prev = F.col("prev")
    eligible = (
        (F.col("promo_type") == NO_PROMO) & (prev["promo_type"] == NO_PROMO) & _enough("prev")
        & (F.abs(F.col("price") - prev["price"]) > EPSILON)
    )
    value = _elasticity(F.col("price"), F.col("avg_units"), prev["price"], prev["avg_units"])
    return prev_block(blocks).withColumn("e_regular", F.when(eligible, value))


def with_promo_elasticity(blocks: DataFrame) -> DataFrame:
    """Add `ref` and `e_promo` for price-only promotions against their reference block."""
    ref = F.col("ref")
    value = _elasticity(F.col("avg_price"), F.col("avg_units"), ref["price"], ref["avg_units"])
    return last_regular_block(blocks).withColumn(
        "e_promo", F.when((F.col("promo_type") == INSTORE_ONLY) & _enough("ref"), value))


def with_multipliers(blocks: DataFrame) -> DataFrame:
    """Add `e_ref`, `m_raw` and `m_value` to blocks promoted with flyer and/or coupon.

    `e_ref` is the last promo elasticity measured against the same reference
    block, wherever in the series it was measured. `m_raw` is the multiplier as
    computed, `m_value` the same floored at 1.
    """
    same_ref = Window.partitionBy(*SERIES, F.col("ref")["block_id"])
    measured = F.when(F.col("e_promo").isNotNull(), F.col("block_id"))
    e_ref = F.when(F.col("ref").isNotNull(), F.max_by("e_promo", measured).over(same_ref))
    ref = F.col("ref")
    floor = F.lit(EPSILON)
    lift = F.greatest(F.col("avg_units"), floor) / F.greatest(ref["avg_units"], floor)
    ratio = F.greatest(F.col("avg_price"), floor) / F.greatest(ref["price"], floor)
    known = (
        F.col("promo_type").isin(*MULTIPLIERS) & _enough("ref") & F.col("e_ref").isNotNull()
        & F.col("avg_units").isNotNull() & ref["avg_units"].isNotNull()
        & F.col("avg_price").isNotNull() & ref["price"].isNotNull()
    )
    staged = blocks.withColumn("e_ref", e_ref).withColumn(
        "m_raw", F.when(known, raw_multiplier(lift, ratio, F.col("e_ref"))))
    return staged.withColumn("m_value", F.when(F.col("m_raw").isNotNull(), F.greatest(F.lit(1.0), F.col("m_raw"))))


def _multiplier_key() -> Column:
    key = F.lit(None).cast("string")
    for promo_type, name in MULTIPLIERS.items():
        key = F.when(F.col("promo_type") == promo_type, name).otherwise(key)
    return key


def _shown(value: Column) -> Column:
    """Half up to cents; the noise of a float mean, below 1e-6, does not decide a tie."""
    return metric_round(F.round(value, 6))


def block_metrics(blocks: DataFrame) -> DataFrame:
    """Unlabelled metrics: (upc, store, block_id, metric, raw_value, weeks, detail, unfloored, elasticity_used).

    A block yields at most one metric, so this is a projection, not a union. The last
    two are a multiplier's value before the floor and the promo elasticity it was
    computed with; null for elasticities.
    """
    rows = with_multipliers(with_promo_elasticity(with_regular_elasticity(blocks)))
    is_regular, is_promo = F.col("e_regular").isNotNull(), F.col("e_promo").isNotNull()
    base = F.when(is_regular, F.col("prev")).otherwise(F.col("ref"))
    price = F.when(is_regular, F.col("price")).otherwise(F.col("avg_price"))
    detail = F.format_string(
        "from P=%.2f(%dw)@U=%.2f to P=%.2f(%dw)@U=%.2f",
        _shown(base["price"]), base["weeks"], _shown(base["avg_units"]),
        _shown(price), F.col("weeks"), _shown(F.col("avg_units")))
    return rows.select(
        *SERIES, "block_id",
        F.when(is_regular, "E_regular").when(is_promo, "E_promo").otherwise(_multiplier_key()).alias("metric"),
        F.coalesce("e_regular", "e_promo", "m_value").alias("raw_value"),
        (F.col("weeks") + base["weeks"]).cast("int").alias("weeks"),
        detail.alias("detail"),
        F.when(~is_regular & ~is_promo, F.col("m_raw")).alias("unfloored"),
        F.when(~is_regular & ~is_promo, F.col("e_ref")).alias("elasticity_used"),
    ).filter(F.col("raw_value").isNotNull())


def label_metrics(metrics: DataFrame) -> DataFrame:
    """Suffix _1, _2, ... where a series has several values of one metric."""
    same = Window.partitionBy(*SERIES, "metric")
    nth = F.row_number().over(same.orderBy("block_id"))
    several = F.count(F.lit(1)).over(same) > 1
    return metrics.withColumn(
        "key", F.when(several, F.concat_ws("_", "metric", nth.cast("string"))).otherwise(F.col("metric")))


def elasticity_metrics(panel: DataFrame, detail: bool = False) -> DataFrame:
    """Panel to metric rows (upc, store, key, value, weeks)."""
    blocks = block_table(clean_series(panel.repartition(*SERIES)))
    rows = label_metrics(block_metrics(blocks))
    extra = ["detail"] if detail else []
    return rows.select(*SERIES, "key", metric_round(F.col("raw_value")).alias("value"), "weeks", *extra)


def metrics_map(metrics: DataFrame) -> DataFrame:
    """One row per series with a map key -> (value, weeks)."""
    entries = F.collect_list(F.struct("key", F.struct("value", "weeks")))
    return metrics.groupBy(*SERIES).agg(F.map_from_entries(F.array_sort(entries)).alias("metrics"))


def metric_order(metrics: DataFrame) -> DataFrame:
    """Display order: series, metric kind, then number."""
    kinds = ["E_regular", "E_promo", *MULTIPLIERS.values()]
    stem = F.regexp_replace("key", r"_\d+$", "")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), stem)
    number = F.regexp_extract("key", r"_(\d+)$", 1).try_cast("int")
    return metrics.withColumns({
        "kind_rank": rank.cast("int"), "number": F.coalesce(number, F.lit(0)),
    }).orderBy(*SERIES, "kind_rank", "number")
