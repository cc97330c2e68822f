"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings, which stand for a word's inflections, hashed to
``2 ** BITS`` places. The machine adds a weight for each term and,
for each pair of terms, the product of their factor vectors: so an insult together with a word for a group can weigh more
than both alone. Terms enter in two steps. First those that go with the label more than chance would have it; then, for
what the machine of these leaves unexplained, both terms of every pair that goes with the rest of the label more than
chance would have it, however neutral each is alone. It is fitted by adaptive gradient steps to labelled documents, at
most ``sample`` of them, chosen by a hash of their ids; that bound and the tables of places and pairs bound what the
driver holds and what is broadcast. Scoring reads every whole text once, without a shuffle.

Labels, languages, sources and ids are never inputs of a score. Rows with a null label or id don't train; documents with
equal terms count once, with their mean label. Null and empty texts get the score of a document without terms. Without
any training row every score is 0.5. A null doc_id and repeated rows are scored like any other. Other columns are kept
by ``drop_toxic`` and not looked at otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm.frames import column

BITS, FACTORS, SAMPLE, THRESHOLD, SEED = 18, 4, 10_000, 0.7, 7
EPOCHS, BATCH, RATE, DECAY, FACTOR_DECAY = 40, 64, 0.2, 1e-3, 1e-2
LEAST, DEVIATIONS = 4, 3.5  # examples a term needs, and standard deviations from what the label's share would give
BEGINNINGS = (4, 5, 6)
#: Documents that a pair needs, its deviations from what the machine expects, places of the table of pairs, and the share
#: of uncertainty under which a document is explained. A training document of over PAIR_TERMS terms bears on no pair:
#: that bounds the work of the fit, as SAMPLE does; scoring knows no such bound.
PAIR_LEAST, PAIR_DEVIATIONS, PAIR_BITS, EXPLAINED, PAIR_TERMS = 10, 6.0, 21, 0.02, 1500

_WORD = re.compile(r"\w+")


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted places of a text's distinct words and their beginnings."""
    found = set(_WORD.findall((text or "").lower()))
    found.update([f"{w[:n]}*" for n in BEGINNINGS for w in found if len(w) >= n])
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & mask for w in found), np.int32, len(found)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id may not be learnt; a null id is not held out, and learns nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # by place
    factors: np.ndarray  # by place

    def margin(self, places: np.ndarray) -> float:
        v = self.factors[places]
        pairs = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return self.bias + float(self.weights[places].sum()) + pairs

    def score(self, places: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.margin(places), -40, 40))))


def fit(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """A machine of the terms that go with the label, by themselves or in pairs."""
    size = 1 << bits
    if not len(examples):
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    counts, excess = np.zeros(size, np.int64), np.zeros(size)
    for places, label in zip(examples, labels):  # places of one example are distinct
        counts[places] += 1
        excess[places] += label - share
    known = (counts >= LEAST) & (np.abs(excess) >= DEVIATIONS * np.sqrt(share * (1 - share) * counts))
    machine = _fitted(examples, labels, known, share, factors, epochs)
    expected = np.array([machine.score(x[known[x]]) for x in examples])
    paired = paired_terms([x[counts[x] >= PAIR_LEAST] for x in examples], labels, expected)
    if known[paired].all():
        return machine
    known[paired] = True
    return _fitted(examples, labels, known, share, factors, epochs)


def paired_terms(examples: list[np.ndarray], labels: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The terms of pairs that go with what is left of the label. Pairs are summed in a table by a hash; the pairs of its
    conspicuous places are then counted one by one."""
    rest, spread = labels - expected, expected * (1 - expected)
    few = np.array([len(x) <= PAIR_TERMS for x in examples])
    unsure = np.flatnonzero(few & ((spread > EXPLAINED * (1 - EXPLAINED)) | (np.abs(rest) > EXPLAINED)))
    mask = np.uint64((1 << PAIR_BITS) - 1)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the unsure documents, as one number each, and the documents that hold them, some documents at a time."""
        codes, owners, size = [], [], 0
        for d in unsure.tolist():
            x = examples[d].astype(np.uint64)
            i, j = np.triu_indices(len(x), 1)
            codes.append(x[i] << np.uint64(32) | x[j])
            owners.append(np.full(len(i), d, np.int32))
            size += len(i)
            if size >= 1 << 20:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, size = [], [], 0
        if codes:
            yield np.concatenate(codes), np.concatenate(owners)

    def place(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS) & mask).astype(np.int64)

    excess, variance = (np.zeros(1 << PAIR_BITS) for _ in range(2))
    for codes, owners in pairs():
        at = place(codes)
        excess += np.bincount(at, rest[owners], 1 << PAIR_BITS)
        variance += np.bincount(at, spread[owners], 1 << PAIR_BITS)
    # other pairs of a place add noise of its own spread, so half the deviations suffice here
    found = np.abs(excess) >= PAIR_DEVIATIONS / 2 * np.sqrt(np.maximum(variance, 1e-9))
    sums: dict[int, list[float]] = {}
    for codes, owners in pairs():
        hit = found[place(codes)]
        for code, d in zip(codes[hit].tolist(), owners[hit].tolist()):
            own = sums.setdefault(code, [0, 0.0, 0.0])
            own[0] += 1
            own[1] += rest[d]
            own[2] += spread[d]
    kept = [c for c, (n, e, s) in sums.items() if n >= PAIR_LEAST and abs(e) >= PAIR_DEVIATIONS * max(s, 1e-9) ** 0.5]
    return np.unique(np.array([x for c in kept for x in (c >> 32, c & 0xFFFFFFFF)], dtype=np.int64))


def _fitted(examples: list[np.ndarray], labels: np.ndarray, known: np.ndarray, share: float, factors: int, epochs: int) -> Machine:
    """Adaptive gradient steps on the log loss in small batches, for the known terms."""
    size = len(known)
    machine = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    examples = [x[known[x]] for x in examples]
    random = np.random.default_rng(SEED)
    machine.factors[known] = random.normal(0, 0.01, (int(known.sum()), factors))
    machine.bias = float(np.log(share / (1 - share)))
    w, v = machine.weights, machine.factors
    w_sum, v_sum, b_sum = np.full(size, 1e-2, np.float32), np.full((size, factors), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(examples)), -(-len(examples) // BATCH)):
            sizes = np.array([len(examples[i]) for i in batch])
            at = np.concatenate([examples[i] for i in batch])
            if not len(at):
                continue
            row = np.repeat(np.arange(len(batch)), sizes)
            own = v[at]
            sums = np.stack([np.bincount(row, own[:, f], len(batch)) for f in range(factors)], axis=1)
            squares = np.bincount(row, (own**2).sum(axis=1), len(batch))
            margin = machine.bias + np.bincount(row, w[at], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[batch]
            g = error.mean()
            b_sum += g * g
            machine.bias -= RATE * g / np.sqrt(b_sum)
            places, back = np.unique(at, return_inverse=True)
            each = error[row] / len(batch)
            gw = np.bincount(back, each, len(places)) + DECAY * w[places] / len(batch)
            gv = np.stack([np.bincount(back, each * (sums[row, f] - own[:, f]), len(places)) for f in range(factors)], axis=1)
            gv += FACTOR_DECAY * v[places] / len(batch)
            w_sum[places] += gw**2
            v_sum[places] += gv**2
            w[places] -= RATE * gw / np.sqrt(w_sum[places])
            # a pairwise effect needs both its terms to be common enough: the same rate on a tenth of the scale
            v[places] -= 0.1 * RATE * gv / np.sqrt(v_sum[places])
    return machine


def _termer(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [terms(t.as_py(), bits).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary())], names=["toxic", "places"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, bits: int = BITS) -> Machine:
    """A machine fitted to labelled documents that are not held out."""
    own = labels.select(column(labels, id_col).alias("doc"), column(labels, label_col).cast("double").alias("toxic"))
    own = own.filter(F.col("doc").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc")))
    own = own.groupBy("doc").agg(F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc"), "doc").limit(sample)
    rows = docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).alias("text")).join(F.broadcast(own), "doc")
    # repeated ids can't make it more than sample: one text for each id
    rows = rows.groupBy("doc").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("toxic", "text")
    found: dict[bytes, list[float]] = {}
    for toxic, places in rows.mapInArrow(_termer(bits), "toxic double, places binary").toLocalIterator():
        found.setdefault(bytes(places), []).append(toxic)
    ordered = sorted(found.items())  # whatever the order in which rows come
    return fit([np.frombuffer(x, np.int32) for x, _ in ordered], np.array([np.mean(sorted(y)) for _, y in ordered]), bits)


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        bits = len(machine.weights).bit_length() - 1
        for batch in batches:
            scores = [machine.score(terms(t.as_py(), bits)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])
    return run


def scores(docs: DataFrame, machine: Machine, key: Column, text_col: str = "text") -> DataFrame:
    """key, score: one row per document."""
    rows = docs.select(key.alias("key"), column(docs, text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return rows.mapInArrow(_scorer(shared), f"key {rows.schema['key'].dataType.simpleString()}, score double")


def _keeper(shared, at: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        bits = len(machine.weights).bit_length() - 1
        for batch in batches:
            kept = [machine.score(terms(t.as_py(), bits)) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))
    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(_keeper(shared, at, threshold), docs.schema)
