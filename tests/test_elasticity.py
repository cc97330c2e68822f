"""Elasticity: hand-worked cases and a plain Python model on random panels."""

import math
import random
import statistics
from itertools import groupby

import pytest

from liftline.plans import elasticity as E

SCHEMA = ("upc string, store string, yr_wk int, regular_price double, retail_price double, units double, "
          "sales double, instore_promo int, flyer int, cpp int")


def make(spark, rows):
    """rows: (weeks, regular, retail, units or list, (instore, flyer, cpp)) blocks of one series."""
    out, wk = [], 0
    for n, regular, retail, units, flags in rows:
        values = units if isinstance(units, list) else [units] * n
        for u in values:
            wk += 1
            out.append(("A", "1", wk, regular, retail, float(u), float(u) * retail, *flags))
    return spark.createDataFrame(out, SCHEMA)


def metrics(df):
    return {r["key"]: (r["value"], r["weeks"]) for r in E.elasticity_metrics(df).collect()}


OFF, PRICE_ONLY, FLYER = (0, 0, 0), (1, 0, 0), (1, 1, 0)
WORKED = [
    (4, 10.0, 10.0, 100, OFF), (2, 12.0, 12.0, 80, OFF), (2, 12.0, 9.0, 240, FLYER),
    (2, 12.0, 9.6, 120, PRICE_ONLY), (2, 30.0, 30.0, 70, OFF), (1, 12.3, 12.3, 75, OFF)]


def test_worked_series(spark):
    assert metrics(make(spark, WORKED)) == {
        "E_regular": (-1.22, 6), "E_promo": (-1.82, 4), "M_instore_flyer": (1.78, 4)}


def test_processed_prices(spark):
    rows = E.block_table(E.clean_series(make(spark, WORKED))).orderBy("block_id").collect()
    assert [r["price"] for r in rows] == [10.0, 12.0, 12.0, 12.0, 12.0, 12.0]
    assert [r["avg_price"] for r in rows] == [10.0, 12.0, 9.0, 9.6, 12.0, 12.3]


def test_lasting_jump_is_never_adopted(spark):
    rows = E.block_table(E.clean_series(make(spark, [
        (2, 10.0, 10.0, 5, OFF), (2, 20.0, 20.0, 5, OFF), (2, 21.0, 21.0, 5, OFF)]))).collect()
    assert {r["price"] for r in rows} == {10.0}


@pytest.mark.parametrize("units, lo, hi, kept, mean", [
    ([90, 100, 110, 120, 500], 70, 150, 4, 105),
    ([100, 100, 100, 100, 400], 100 - 1e-9, 100 + 1e-9, 4, 100),
    ([1, 50, 900], 1 - 1e-9, 900 + 1e-9, 3, 317)])
def test_unit_bounds(spark, units, lo, hi, kept, mean):
    rows = E.with_blocks(E.clean_series(make(spark, [(len(units), 10.0, 10.0, units, OFF)])))
    bound = E.iqr_bounds(rows).first()
    assert (bound["lo"], bound["hi"]) == pytest.approx((lo, hi), abs=1e-12)
    stats = E.block_stats(rows).first()
    assert (stats["kept_weeks"], stats["weeks"], stats["avg_units"]) == (kept, len(units), pytest.approx(mean))


def test_positive_elasticity_is_dropped(spark):
    assert metrics(make(spark, [(2, 10.0, 10.0, 80, OFF), (2, 12.0, 12.0, 100, OFF)])) == {}


def test_no_reference_block(spark):
    assert metrics(make(spark, [(2, 12.0, 9.0, 240, FLYER), (2, 12.0, 9.6, 120, PRICE_ONLY)])) == {}


def test_promo_classes(spark):
    rows = [("A", "1", 1, 10.0, 8.0, 1.0, 1.0, 1, 1, 1), ("A", "1", 2, 10.0, None, 1.0, 1.0, None, 1, 0),
            ("A", "1", 3, 10.0, 8.0, 1.0, 1.0, 0, 1, 1)]
    got = E.clean_series(spark.createDataFrame(rows, SCHEMA)).orderBy("yr_wk").collect()
    assert [(r["promo_type"], r["retail_price"]) for r in got] == [
        ("Instore_Flyer_CPP", 8.0), ("Other_Promo", 10.0), ("No_Promo", 10.0)]


def test_several_values_are_numbered(spark):
    got = metrics(make(spark, [(2, 10.0, 10.0, 100, OFF), (2, 12.0, 12.0, 80, OFF), (2, 14.0, 14.0, 60, OFF)]))
    assert sorted(got) == ["E_regular_1", "E_regular_2"]


# --- plain model of one series: lists and loops, no frame library ---------------

def quantile(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    low = int(at)
    return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)


def kept_units(units):
    if len(units) < 4:
        return [True] * len(units)
    q1, q3 = quantile(units, .25), quantile(units, .75)
    if q1 == q3:
        return [u == statistics.median(units) for u in units]
    return [q1 - 1.5 * (q3 - q1) <= u <= q3 + 1.5 * (q3 - q1) for u in units]


def model(rows):
    def kind(r):
        flags = r[7:10]
        if flags[0] == 0:
            return "No_Promo"
        return {(1, 0, 0): "Instore_Only", (1, 1, 0): "Instore_Flyer", (1, 0, 1): "Instore_CPP",
                (1, 1, 1): "Instore_Flyer_CPP"}.get(flags, "Other_Promo")

    blocks, carried = [], None
    for (typ, _), part in groupby(rows, key=lambda r: (kind(r), r[3] if kind(r) == "No_Promo" else None)):
        part = list(part)
        price, spiked = statistics.median(r[3] for r in part), False
        if typ == "No_Promo":
            change = abs(price - carried) / carried if carried else None
            spiked = change is not None and change > .5
            if change is not None and (spiked or change <= .05):
                price = carried
            carried = price
        keep = kept_units([r[5] for r in part])
        retail = [r[3] if typ == "No_Promo" else (r[3] if r[4] is None else r[4]) for r in part]
        inside = [(r[5], x) for r, x, k in zip(part, retail, keep) if k]
        blocks.append(dict(
            typ=typ, price=price, n=len(part), units=statistics.fmean(u for u, _ in inside),
            avg=price if spiked else statistics.fmean(x for _, x in inside)))

    def log(a, b):
        return math.log(max(a, 1e-9) / max(b, 1e-9))

    found, last, refs = [], None, []
    for i, b in enumerate(blocks):
        refs.append(last)
        if b["typ"] == "No_Promo":
            p = blocks[i - 1] if i else None
            if p and p["typ"] == "No_Promo" and abs(b["price"] - p["price"]) > 1e-9:
                e = log(b["units"], p["units"]) / log(b["price"], p["price"])
                if e < 0:
                    found.append((i, "E_regular", e, b["n"] + p["n"]))
            last = i
    measured = {}
    for i, b in enumerate(blocks):
        r = blocks[refs[i]] if refs[i] is not None else None
        if b["typ"] == "Instore_Only" and r and abs(log(b["avg"], r["price"])) > 1e-9:
            e = log(b["units"], r["units"]) / log(b["avg"], r["price"])
            if e < 0:
                measured[refs[i]] = e
                found.append((i, "E_promo", e, b["n"] + r["n"]))
    for i, b in enumerate(blocks):
        if b["typ"].startswith("Instore_") and b["typ"] != "Instore_Only" and refs[i] in measured:
            r = blocks[refs[i]]
            expected = (max(b["avg"], 1e-9) / max(r["price"], 1e-9)) ** measured[refs[i]]
            if expected > 1e-9:
                lift = max(b["units"], 1e-9) / max(r["units"], 1e-9)
                found.append((i, "M_" + b["typ"].lower(), max(1.0, lift / expected), b["n"] + r["n"]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_model(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for s in range(30):
        price, series = 10.0, []
        for wk in range(1, 120):
            if rng.random() < .15:
                price = round(price * rng.choice([.45, .8, .97, 1.03, 1.2, 1.7]), 2)
            flags = OFF if rng.random() < .5 else (1, rng.randint(0, 1), rng.choice([0, 1, None]))
            retail = rng.choice([None, round(price * rng.choice([.7, .8, .95]), 2)])
            series.append((f"U{s}", "1", wk, price, retail, float(rng.randint(0, 60)), 1.0, *flags))
        rows += series
        want |= {(f"U{s}", b + 1, m, round(v, 6), w) for b, m, v, w in model(series)}
    rng.shuffle(rows)
    got = E.block_metrics(E.block_table(E.clean_series(
        spark.createDataFrame(rows, SCHEMA).repartition(7)))).collect()
    big = 1e6  # multipliers on zero units are compared by magnitude
    as_set = {(r["upc"], r["block_id"], r["metric"], round(r["raw_value"], 6) if r["raw_value"] < big
               else float(f"{r['raw_value']:.6g}"), r["weeks"]) for r in got}
    want = {(u, b, m, v if v < big else float(f"{v:.6g}"), w) for u, b, m, v, w in want}
    assert len(want) > 100
    assert as_set == want


def test_blocks_are_contiguous_and_cover_all_rows(spark):
    rows = E.with_blocks(E.clean_series(make(spark, WORKED)))
    blocks = E.block_stats(rows).orderBy("block_id").collect()
    assert [b["block_id"] for b in blocks] == list(range(1, len(blocks) + 1))
    assert sum(b["weeks"] for b in blocks) == rows.count()


def test_map_and_order(spark):
    rows = E.elasticity_metrics(make(spark, WORKED))
    assert E.metrics_map(rows).first()["metrics"]["E_promo"]["weeks"] == 4
    assert [r["key"] for r in E.metric_order(rows).collect()] == ["E_regular", "E_promo", "M_instore_flyer"]
