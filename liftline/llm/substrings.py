"""Substring deduplication with suffix automata of reference shards.

A word goes if it is inside a window of ``window`` words that also starts in a document with a smaller id.

Automata of all documents can't be broadcast to all documents: that is the square of the corpus. So documents are routed.
Every window has a minimizer, the word 5-gram in it with the smallest hash, which depends on the window alone; equal
windows have equal minimizers. Neighbouring windows with one minimizer are a segment. Only segments whose minimizer
occurs in at least two documents go on, each to the reference shard of its minimizer. There, in the order of ids,
a segment streams through the suffix automaton of the smaller documents' segments; its matching statistics, the length
of the longest suffix of the words so far that occurs there, mark the windows at which they reach the window's length,
and the segment is then added to the automaton. Words are compared as they are; hashes only route.

A minimizer that occurs more than ``crowd`` times would fill one shard. Its windows are compared as texts instead, by an
aggregation that starts before the shuffle and a join that adaptive execution splits.

Null texts have no words. Rows with a null id neither lose words nor count as a smaller document. Rows that repeat an
id don't match one another; each has its own result. An empty table gives an empty result. Other columns are not
looked at. Memory in a task is a document, or the segments of one minimizer that aren't crowded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import words as W
from liftline.llm.exact import row_key
from liftline.llm.frames import checkpointed, column

WINDOW, GRAM, CROWD = 13, 5, 20_000


class SuffixAutomaton:
    """Of several word sequences: every path from the start is a run of words of one of them."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, onward: dict[bytes, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of q for the shorter runs that reach it by word from p and p's suffixes."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def statistics(self, sequence: list[bytes]) -> Iterator[int]:
        """After each word: how many of the last words stand so in one of the added sequences."""
        state = matched = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield matched


def segments(text: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The words joined by one space, their starts and ends, and per segment: minimizer hash, first window, end of windows."""
    plain = b" ".join(text.split())
    data = np.frombuffer(plain, dtype=np.uint8)
    starts, ends = W.word_ranges(data, W.NOT_SPACE)
    n = len(starts) - window + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return plain, starts, ends, none.view(np.uint64), none, none
    words = W.word_hashes(data, starts, ends)
    grams = W.window_hashes(words, gram)
    span = window - gram + 1
    # the place of the first smallest gram in each window, by a running minimum from the left
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = grams[j:n + j]
        less = other < best
        np.copyto(best, other, where=less)
        np.copyto(at, np.arange(j, n + j), where=less)
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    return plain, starts, ends, best[edges], edges, np.append(edges[1:], n)


def _keys(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(segments(t.as_py(), window, gram)[3]).view(np.int64) for t in batch.column(2)]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["doc", "row", "key"])
    return run


def _routed(window: int, gram: int, single: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct segments with the given minimizers, or each of their windows by itself, and where they begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out_keys: list[int] = []
            out_words: list[bytes] = []
            out_at: list[list[int]] = []
            for row, (text, known) in enumerate(zip(batch.column(2), batch.column(3))):
                plain, starts, ends, keys, first, end = segments(text.as_py(), window, gram)
                keys = keys.view(np.int64)
                chosen = np.flatnonzero(np.isin(keys, known.values.to_numpy()))
                begins, stops = starts.tolist(), ends.tolist()
                found: dict[tuple[int, bytes], list[int]] = {}
                for key, a, b in zip(keys[chosen].tolist(), first[chosen].tolist(), end[chosen].tolist()):
                    for x, y in ([(i, i + 1) for i in range(a, b)] if single else [(a, b)]):
                        found.setdefault((key, plain[begins[x]:stops[y + window - 2]]), []).append(x)
                rows += [row] * len(found)
                out_keys += [k for k, _ in found]
                out_words += [w for _, w in found]
                out_at += found.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(out_keys, pa.int64()), pa.array(out_words, pa.binary()),
                 pa.array(out_at, pa.list_(pa.int64()))], names=["doc", "row", "key", "words", "at"])
    return run


class _Shard:
    """The segments of one minimizer, in the order of ids."""

    def __init__(self, window: int) -> None:
        self.window, self.first = window, {}
        self.automaton: SuffixAutomaton | None = None
        self.smaller: list[list[bytes]] = []  # not yet added to the automaton
        self.own: list[list[bytes]] = []  # of the document being read
        self.doc = None

    def mask(self, doc, words: bytes) -> int:
        """Bit i: the segment's window i also stands in a smaller document."""
        if doc != self.doc:
            self.smaller += self.own
            self.own, self.doc = [], doc
        sequence = words.split(b" ")
        if words in self.first:
            if self.first[words][0] != doc:
                return (1 << (len(sequence) - self.window + 1)) - 1
            return self.first[words][1]
        mask = 0
        if self.smaller or self.automaton:
            self.automaton = self.automaton or SuffixAutomaton()
            for other in self.smaller:
                self.automaton.add(other)
            self.smaller = []
            for i, matched in enumerate(self.automaton.statistics(sequence)):
                if matched >= self.window:
                    mask |= 1 << (i - self.window + 1)
        self.first[words] = (doc, mask)
        self.own.append(sequence)
        return mask


def _shards(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = None, None
        for batch in batches:
            rows, masks = [], []
            for i, (doc, key, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if shard is None or key != current:
                    shard, current = _Shard(window), key
                if mask := shard.mask(doc, words):
                    rows.append(i)
                    masks.append(mask)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 4)), pa.array(masks, pa.int64())], names=["doc", "row", "at", "mask"])
    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, froms, tos, kept = [], [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                parts = (text.as_py() or b"").split()
                a = b = []
                if marks.is_valid and len(marks):
                    at = marks.values.field(0).to_numpy()
                    mask = marks.values.field(1).to_numpy()
                    begin = np.concatenate([at[mask >> i & 1 == 1] + i for i in range(int(mask.max()).bit_length())])
                    gone = W.covered(np.unique(begin), window, len(parts))
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                    a, b = edges[::2], edges[1::2]
                counts.append(len(parts))
                froms.append(a)
                tos.append(b)
                bounds = [0, *(x for pair in zip(a, b) for x in pair), len(parts)]
                kept.append(b" ".join([w for x, y in zip(bounds[::2], bounds[1::2]) for w in parts[x:y]]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(froms, pa.list_(pa.int64())), pa.array(tos, pa.list_(pa.int64())),
                 pa.array(kept, pa.string())], names=["doc", "n_words", "cut_from", "cut_to", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                   crowd: int = CROWD) -> DataFrame:
    """One row per document: doc, n_words, cut_from and cut_to (maximal runs of removed words, end exclusive), kept_text
    (the words left, joined by one space)."""
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("doc"), row_key(text).alias("row"), F.encode(text, "UTF-8").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    known = rows.filter("doc is not null")
    keys = known.mapInArrow(_keys(window, gram), f"doc {kind}, row long, key long")
    repeated = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    # under another name the counts are shuffled once more, and the join of two shuffles can be split where a key is frequent
    repeated = repeated.select(F.bitwise_not("key").alias("flipped"), (F.col("n") > crowd).alias("crowded"))
    own = checkpointed(keys.join(repeated, F.col("key") == F.bitwise_not("flipped")).groupBy("doc", "row", "crowded").agg(F.collect_set("key").alias("keys")))

    def routed(crowded: bool) -> DataFrame:
        chosen = known.join(own.filter(F.col("crowded") == crowded), ["doc", "row"]).select("doc", "row", "text", "keys")
        return chosen.mapInArrow(_routed(window, gram, crowded), f"doc {kind}, row long, key long, words binary, at array<long>")

    shards = routed(False).repartition("key").sortWithinPartitions("key", "doc")
    marks = shards.mapInArrow(_shards(window), f"doc {kind}, row long, at array<long>, mask long")
    if not own.filter("crowded").isEmpty():
        windows = routed(True)
        first = windows.groupBy("words").agg(F.min("doc").alias("least")).select(F.reverse("words").alias("backward"), "least")
        again = windows.join(first, F.col("words") == F.reverse("backward")).filter("doc > least")
        marks = marks.unionByName(again.select("doc", "row", "at", F.lit(1).cast("long").alias("mask")))
    marks = marks.select("doc", "row", "mask", F.explode("at").alias("at")).groupBy("doc", "row").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    marks = checkpointed(marks)
    return rows.join(marks, ["doc", "row"], "left").select("doc", "text", "marks").mapInArrow(
        _cut(window), f"doc {kind}, n_words long, cut_from array<long>, cut_to array<long>, kept_text string")
