"""Periodic runs of words inside each text, found by seeds on diagonals and extended.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``least`` words and
``repeats`` periods long, that no neighbouring word extends. A run laid over itself q words later agrees in at least
max(least, repeats * q) - q words. So periods are taken in classes, each class twice as wide as the one before, and the
smallest such overlap in a class is the length k of its k-grams: every run of the class has a k-gram at its first word
and again q words later. Equal k-grams of one text are indexed, and each occurrence is paired with the next one. That
pair is enough: k is at least q, so inside a run no k-gram comes back sooner than after q words. A class looks only at
places whose k-gram was already repeated in the class before.

A pair is a seed on the diagonal of its lag. It is extended to both sides while words agree. A table per lag holds how
far the diagonal is covered, and a seed below that is not extended again. As k is at least the lag, an extended seed is
a stretch of two periods or more, of which a text of n words has fewer than n: neither all pairs of a frequent k-gram
nor a diagonal per lag are ever made. Words are compared by 64-bit hashes first; every run found is then compared word by word.

Null texts have no words. Rows are independent of one another: repeated ids and repeated rows have a result each, a
null id is carried through. Empty tables give empty results; other columns are not looked at. Memory in a task is one
text, or several that have ``CHUNK`` words together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm import words as W
from liftline.llm.frames import column

LEAST, REPEATS, CHUNK = 24, 3, 1 << 19
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
RUNS = "array<struct<start:long,length:long,period:long>>"
_FIELD = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def period_classes(most: int, least: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(first period, last period, k) of the classes of periods up to most."""
    low, high = 1, max(1, least // repeats)
    while low <= most:
        yield low, high, min(max(least, repeats * q) - q for q in (low, high))
        low, high = high + 1, 2 * high


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _STEP + b
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


class _Grams:
    """Hashes of the k-grams at chosen places of a word sequence, from hashes of grams of doubled lengths."""

    def __init__(self, ids: np.ndarray) -> None:
        self.doubled = [_mixed(ids.astype(np.uint64), np.uint64(1) + np.zeros(len(ids), np.uint64))]

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        level = k.bit_length() - 1
        while len(self.doubled) <= level:
            h, size = self.doubled[-1], 1 << (len(self.doubled) - 1)
            self.doubled.append(_mixed(h[:-size], h[size:]) if len(h) > size else h[:0])
        h = self.doubled[level]
        return _mixed(h[places], h[places + (k - (1 << level))])


def _extended(ids: np.ndarray, at: int, lag: int, first: int, end: int) -> tuple[int, int]:
    """The longest stretch [a, b) around at in which every word equals the one lag words on; words are [first, end)."""
    a, b, size = at, at, 64
    while b + lag < end:
        size = min(size, end - lag - b)
        differs = np.flatnonzero(ids[b:b + size] != ids[b + lag:b + lag + size])
        if len(differs):
            b += int(differs[0])
            break
        b, size = b + size, 2 * size
    size = 64
    while a > first:
        size = min(size, a - first)
        differs = np.flatnonzero(ids[a - size:a] != ids[a - size + lag:a + lag])
        if len(differs):
            a += int(differs[-1]) + 1 - size
            break
        a, size = a - size, 2 * size
    return a, b


def runs_of(ids: np.ndarray, edges: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a row of texts: ids are word numbers, equal for equal words, and text j has
    those from edges[j] to edges[j + 1]. Starts count from the first word of all."""
    if not len(ids):
        return []
    if repeats < 3:
        raise ValueError("runs have three periods or more")
    ends = np.repeat(edges[1:], np.diff(edges))
    text = np.repeat(np.arange(len(edges) - 1, dtype=np.uint64), np.diff(edges))
    places, grams, runs = np.arange(len(ids)), _Grams(ids), []
    for low, high, k in period_classes(int(np.diff(edges).max()) // repeats, least, repeats):
        places = places[places + k <= ends[places]]
        hashes = _mixed(grams.at(places, k), text[places])
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(places), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        again = order[again]
        places = places[again]
        if not len(places):
            break
        order = np.lexsort((places, hashes[again]))
        places, hashes = places[order], hashes[again][order]
        lags = np.where(hashes[1:] == hashes[:-1], places[1:] - places[:-1], 0)
        seeds = np.flatnonzero((lags >= low) & (lags <= high))
        at, lags = places[seeds], lags[seeds]
        order = np.lexsort((at, lags))
        at, lags = at[order], lags[order]
        # a seed one word after another on the same diagonal is covered by the other's extension
        heads = np.ones(len(at), dtype=bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, lag in zip(at[heads].tolist(), lags[heads].tolist()):
            if i < covered.get(lag, 0):
                continue
            j = int(text[i])
            a, b = _extended(ids, i, lag, int(edges[j]), int(edges[j + 1]))
            covered[lag] = b
            if b > i and b - a + lag >= max(least, repeats * lag):
                runs.append((a, b - a + lag, lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _results(texts: list[bytes], least: int, repeats: int) -> tuple[list, list, list]:
    """Word counts, runs and kept words of some texts, worked on together. Words stand for themselves by their hashes;
    texts in which that makes a difference for a run are done again with words numbered exactly."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends = W.word_ranges(data, W.NOT_SPACE)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, length, period in runs_of(W.word_hashes(data, starts, ends), edges, least, repeats):
        j = int(np.searchsorted(edges, a, side="right")) - 1
        runs[j].append((a - int(edges[j]), length, period))
    kept = []
    for j, text in enumerate(texts):
        words = text.split()  # of bytes: at the six ASCII white spaces
        if runs[j]:
            if any(words[a + q:a + n] != words[a:a + n - q] for a, n, q in runs[j]):
                names: dict[bytes, int] = {}
                numbers = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
                runs[j] = runs_of(numbers, np.array([0, len(words)]), least, repeats)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for a, length, period in runs[j]:
                change[a + period] += 1
                change[a + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        kept.append(b" ".join(words))
    return np.diff(edges).tolist(), runs, kept


def periodic_runs(docs: DataFrame, text: Column | str = "text", id_col: str = "doc_id", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row per row of docs: doc, n_words, runs (start, length and period in words, by start and then period) and
    kept_text: the words, joined by one space, that no run holds after its first period."""
    text = column(docs, text) if isinstance(text, str) else text
    rows = docs.select(column(docs, id_col).alias("doc"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = 0, 0
            lengths = [len(t) for t in (x.as_buffer() or b"" for x in batch.column(1))]
            for end, length in enumerate(lengths, 1):
                size += length
                if size >= 6 * CHUNK or end == len(lengths):
                    part = batch.slice(at, end - at)
                    counts, runs, kept = _results([x.as_py() for x in part.column(1)], least, repeats)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(counts, pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], _FIELD),
                         pa.array([k.decode() for k in kept], pa.string())], names=["doc", "n_words", "runs", "kept_text"])
                    at, size = end, 0

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, n_words long, runs {RUNS}, kept_text string")


def strongest(runs: Column) -> Column:
    """The run that has the greatest length / period, compared exactly; of equal ones the first to start, then the shortest period."""
    more = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | (
        (a["length"] * b["period"] == b["length"] * a["period"]) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def runs_by_definition(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """The same runs by trying every period at every place; for tests."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // repeats + 1):
        a = 0
        while a + q < len(words):
            b = a
            while b + q < len(words) and words[b] == words[b + q]:
                b += 1
            if b - a + q >= max(least, repeats * q) and (a, b + q) not in found:
                found[a, b + q] = q  # periods ascend, so the first is the smallest
            a = b + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))
