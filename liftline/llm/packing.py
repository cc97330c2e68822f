"""Best-fit packing of tokenised documents into sequences, improved by swaps.

A document is its token ids and an end id. Documents longer than a sequence are cut into whole sequences, of which the
first may be shorter; whole pieces fill a sequence alone. The other pieces are dealt at random, by a hash, to groups of
about ``group_pieces``. In a group, best fit in falling length opens the sequences; then a local search moves a piece,
or exchanges one piece for one or two, between underfull sequences whenever that raises the sum of squared fills, until
sequences run empty. The token ids themselves are never shuffled: only lengths and checksums are.

A group's size is bounded, whatever the input's size; more input makes more groups, each of which leaves about one
sequence partly filled. The local search looks at underfull sequences only and stops when no change helps: every change
raises the sum of squared fills, so it ends.

Texts are encoded word by word: where a single space stands between two characters that are not white space, the
vocabulary's splitting rule always starts anew, so equal words have equal ids and are looked up. All other texts are
encoded as a whole. Added tokens of the vocabulary's file, as an end mark written out in a text, have their own ids, as
they have in the tokenizer's library. Null texts count as empty: one piece, the end id. Null and repeated doc_ids are packed like any
other row. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm.frames import checkpointed, column

SEQUENCE = 2048
VOCABULARY, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
END = 0
GROUP_PIECES = 16_384
CACHED_WORDS = 200_000  # about 50 MB in each Python worker, which outlives its task

_NOT_PLAIN = re.compile(r"\s | \s|^ | $")
PIECES = "doc {kind}, piece int, start long, length long, crc long"


class WordIds(dict):
    """Token ids of words, as little-endian bytes; unknown words are encoded and kept, up to a bound."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(ADDED), encoding="utf-8") as described:
            added = {t["content"]: t["id"] for t in json.load(described)["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def whole(self, text: str) -> bytes:
        if self.added.search(text):
            ids = self.encoding.encode(text, allowed_special="all")
        else:
            ids = self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = self.whole(word)
        return ids

    def text(self, text: str) -> bytes:
        """The ids of a text."""
        if not text or _NOT_PLAIN.search(text):
            return self.whole(text) if text else b""
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[f" {word}"] for word in rest])


def word_ids(path: str | None) -> WordIds:
    """One table for each vocabulary and Python process; functions shipped by value have no lasting globals."""
    store = sys.modules.setdefault("_liftline_word_ids", types.ModuleType("_liftline_word_ids")).__dict__
    if path not in store:
        import public_tokenizers

        store[path] = WordIds(path or public_tokenizers.path(VOCABULARY))
    return store[path]


def _pieces(path: str | None, sequence: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tail = word_ids(path), struct.pack("<I", end)
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = table.text(text.as_py() or "") + tail
                at, n = 0, len(ids) // 4
                for k in range(-(-n // sequence)):
                    size = (n - 1) % sequence + 1 if k == 0 else sequence
                    rows.append(row)
                    numbers.append(k)
                    starts.append(at)
                    lengths.append(size)
                    sums.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc", "piece", "start", "length", "crc"])
    return run


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
                     vocabulary: str | None = None, end: int = END) -> DataFrame:
    """doc, piece, start, length, crc: the pieces of every document."""
    rows = docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_pieces(vocabulary, sequence, end), PIECES.format(kind=kind))


def best_fit(lengths: np.ndarray, sequence: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still has room."""
    room: list[list[int]] = [[] for _ in range(sequence + 1)]  # bins by room left
    free: list[int] = []  # the rooms, in order, that some bin has
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect.bisect_left(free, size)
        if at < len(free):
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                free.pop(at)
        else:
            left, b = sequence, len(bins)
            bins.append([])
        bins[b].append(int(i))
        left -= size
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(b)
    return bins


class _Search:
    """Underfull bins and their pieces by length, for moves that raise the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], sequence: int) -> None:
        self.bins, self.len, self.cap = bins, lengths, sequence
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.open = {b for b in range(len(bins)) if 0 < self.fill[b] < sequence}
        self.by_length: dict[int, dict[int, int]] = {}  # length -> piece -> bin
        self.sizes: list[int] = []
        for b in self.open:
            for i in bins[b]:
                self._list(i, b)

    def _list(self, i: int, b: int) -> None:
        size = self.len[i]
        if size not in self.by_length:
            self.by_length[size] = {}
            bisect.insort(self.sizes, size)
        self.by_length[size][i] = b

    def _unlist(self, i: int) -> None:
        size = self.len[i]
        own = self.by_length[size]
        del own[i]
        if not own:
            del self.by_length[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def _shift(self, i: int, a: int, b: int) -> None:
        self.bins[a].remove(i)
        self.bins[b].append(i)
        self.fill[a] -= self.len[i]
        self.fill[b] += self.len[i]
        self.by_length[self.len[i]][i] = b

    def _settle(self, *bins: int) -> None:
        """Full and empty bins leave the search."""
        for b in bins:
            if b in self.open and self.fill[b] in (0, self.cap):
                self.open.discard(b)
                for i in self.bins[b]:
                    self._unlist(i)

    def _source(self, most: int, b: int, gain: int, least: int = 1) -> tuple[int, int] | None:
        """The longest piece of at most that length, in another bin from which taking gain in all is an improvement."""
        at = bisect.bisect_right(self.sizes, most) - 1
        while at >= 0 and self.sizes[at] >= least:
            for i, a in self.by_length[self.sizes[at]].items():
                if a != b and self.fill[a] < self.fill[b] + gain(self.sizes[at]):
                    return i, a
            at -= 1
        return None

    def improve(self, b: int) -> bool:
        """One improving move into bin b, the best found of its kinds; b takes x from a bin a with fill(a) < fill(b) + x."""
        gap = self.cap - self.fill[b]
        found = self._source(gap, b, lambda size: size)  # move
        best = (self.len[found[0]], [found], []) if found else (0, [], [])
        for out in sorted(set(self.len[i] for i in self.bins[b]), reverse=True):
            if best[0] == gap:
                break
            give = next(i for i in self.bins[b] if self.len[i] == out)
            one = self._source(out + gap, b, lambda size: size - out, out + best[0] + 1)  # one for one
            if one:
                best = (self.len[one[0]] - out, [one], [give])
            if best[0] < gap:
                two = self._two(out, gap, b, best[0])
                if two:
                    best = (sum(self.len[i] for i, _ in two) - out, two, [give])
        if not best[0]:
            return False
        _, take, give = best
        a = take[0][1]
        for i, _ in take:
            self._shift(i, a, b)
        for i in give:
            self._shift(i, b, a)
        self._settle(a, b)
        return True

    def _two(self, out: int, gap: int, b: int, least: int) -> list[tuple[int, int]] | None:
        """Two pieces of one bin for one of b: those that fill b best."""
        best, found = least, None
        for a in self.order:
            if a == b or a not in self.open or self.fill[a] >= self.fill[b] + gap:
                continue
            own = sorted(self.bins[a], key=lambda i: self.len[i])
            lo, hi = 0, len(own) - 1
            while lo < hi:
                got = self.len[own[lo]] + self.len[own[hi]] - out
                if got > gap:
                    hi -= 1
                    continue
                if got > best and self.fill[a] < self.fill[b] + got:
                    best, found = got, [(own[lo], a), (own[hi], a)]
                lo += 1
            if best == gap:
                break
        return found

    def run(self) -> None:
        changed = True
        while changed:
            changed = False
            for b in sorted(self.open, key=lambda b: -self.fill[b]):
                # partners for two pieces: the emptiest bins first, which are to be emptied
                self.order = sorted(self.open, key=lambda a: self.fill[a])
                while b in self.open and self.improve(b):
                    changed = True


def pack(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[list[int]]:
    """Bins of indices of a group of pieces."""
    bins = best_fit(lengths, sequence)
    search = _Search(bins, [int(x) for x in lengths], sequence)
    search.run()
    return [b for b in search.bins if b]


def _pack_group(sequence: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the order in which a shuffle delivers rows must not matter
        group = group.sort_values(["length", "crc", "start", "doc"], kind="stable", ignore_index=True)
        number = np.empty(len(group), dtype=np.int64)
        offset = np.empty(len(group), dtype=np.int64)
        lengths = group["length"].to_numpy()
        for b, members in enumerate(pack(lengths, sequence)):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += int(lengths[i])
        return group.drop(columns="shard").assign(sequence_id=(np.int64(key[0]) << 32) + number, offset=offset)
    return run


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
                  vocabulary: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc, piece, start, length, crc, sequence_id, offset: one row per piece."""
    pieces = checkpointed(tokenized_pieces(docs, id_col, text_col, sequence, vocabulary))
    kind = pieces.schema["doc"].dataType.simpleString()
    short = pieces.filter(F.col("length") < sequence)
    groups = -(-short.count() // group_pieces) or 1
    spread = F.pmod(F.xxhash64("doc", "start", "length", "crc", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    schema = PIECES.format(kind=kind) + ", sequence_id long, offset long"
    packed = short.withColumn("shard", spread).groupBy("shard").applyInPandas(_pack_group(sequence), schema)
    # whole pieces: numbers of their own, below zero
    whole = pieces.filter(F.col("length") == sequence).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)
