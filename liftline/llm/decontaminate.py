"""Benchmark decontamination: test windows in a broadcast hash set, documents scanned window by window.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. A benchmark item gives every
window of ``window`` consecutive words; a shorter item, but not an empty one, is one window. The set of window hashes
goes to every task. A document's windows are hashed in numpy; each hash that is in the set is compared word by word.
Documents are read once, as whole texts, without a shuffle.

The set's size is bounded: a benchmark of more than ``part_chars`` characters is dealt by hash into parts below that
bound. Each part makes a pass of its own over the documents, which carry their hits so far from one to the next.

Null texts have no words. Items without an id still hit, but are not named. A null doc_id and repeated rows are carried
through, one result each. Empty tables give no rows, or no hits. Other columns are not looked at, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline.llm import words as W
from liftline.llm.frames import checkpointed, column, free_name

WINDOW = 13
PART_CHARS = 64_000_000
SHARE = 20  # contaminated: at least one word in so many is hit

Index = dict[int, tuple[np.ndarray, dict[bytes, list[str | None]]]]


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = W.LOWER[np.frombuffer(text, dtype=np.uint8)]
    return (data, *W.word_ranges(data, W.ALNUM))


def _phrase(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, size: int) -> bytes:
    return b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(i, i + size))


def window_index(items: list[tuple[object, str | None]], window: int = WINDOW) -> Index:
    """By window length: sorted hashes, and the items of each window's words."""
    found: dict[int, dict[bytes, list]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for item, text in items:
        data, starts, ends = _scan((text or "").encode())
        size = min(window, len(starts))
        if not size:
            continue
        hashes.setdefault(size, []).append(W.window_hashes(W.word_hashes(data, starts, ends), size))
        name = None if item is None else str(item)
        for i in range(len(starts) - size + 1):
            owners = found.setdefault(size, {}).setdefault(_phrase(data, starts, ends, i, size), [])
            if name not in owners[-1:]:
                owners.append(name)
    return {size: (np.unique(np.concatenate(hashes[size])), found[size]) for size in found}


def find_hits(text: bytes, index: Index) -> tuple[int, np.ndarray, np.ndarray, set[str]]:
    """Number of words, starts and ends of the runs of hit words, items whose windows occur."""
    data, starts, ends = _scan(text)
    n, items = len(starts), set()
    hit = np.zeros(n, dtype=bool)
    hashed = W.word_hashes(data, starts, ends) if n else None
    for size, (keys, phrases) in index.items():
        if n < size:
            continue
        here = W.window_hashes(hashed, size)
        at = np.searchsorted(keys, here)
        at[at == len(keys)] = 0
        true = []
        for i in np.flatnonzero(keys[at] == here):
            if (owners := phrases.get(_phrase(data, starts, ends, i, size))) is not None:
                true.append(i)
                items.update(o for o in owners if o is not None)
        if true:
            hit |= W.covered(np.array(true), size, n)
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False)) if n else np.empty(0, dtype=np.int64)
    return n, edges[::2], edges[1::2], items


def _scanner(index, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            out: dict[str, list] = {"n_words": [], "hit_from": [], "hit_to": [], "items": []}
            before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()) if not first else None
            for text in texts:
                n, starts, ends, items = find_hits(text.as_py() or b"", index.value)
                if before is not None:
                    old_from, old_to, old_items = next(before)
                    hit = np.zeros(n + 1, dtype=np.int64)
                    for a, b in ((starts, ends), (old_from, old_to)):
                        np.add.at(hit, np.asarray(a, dtype=np.int64), 1)
                        np.add.at(hit, np.asarray(b, dtype=np.int64), -1)
                    edges = np.flatnonzero(np.diff(np.cumsum(hit)[:n] > 0, prepend=False, append=False))
                    starts, ends, items = edges[::2], edges[1::2], items | set(old_items)
                out["n_words"].append(n)
                out["hit_from"].append(starts.tolist())
                out["hit_to"].append(ends.tolist())
                out["items"].append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(out["n_words"], pa.int64()), pa.array(out["hit_from"], pa.list_(pa.int64())),
                 pa.array(out["hit_to"], pa.list_(pa.int64())), pa.array(out["items"], pa.list_(pa.string()))],
                names=["key", "bytes", "n_words", "hit_from", "hit_to", "items"])
    return run


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_chars: int) -> Iterator[list]:
    """The benchmark's rows, in as many bounded parts as its size needs."""
    items = benchmark.select(column(benchmark, id_col).alias("item"), column(benchmark, text_col).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // part_chars) or 1
    for part in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part)
        yield [tuple(r) for r in rows.collect()]


def hit_spans(docs: DataFrame, benchmark: DataFrame, key: Column, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """key, bytes (the text in UTF-8), n_words, hit_from and hit_to (runs of hit words, end exclusive), items (sorted)."""
    rows = docs.select(key.alias("key"), F.encode(F.coalesce(column(docs, text_col), F.lit("")), "UTF-8").alias("bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, bytes binary, n_words long, hit_from array<long>, hit_to array<long>, items array<string>"
    first = True
    for part in _parts(benchmark, item_col, item_text_col, part_chars):
        index = docs.sparkSession.sparkContext.broadcast(window_index(part, window))
        rows = (rows if first else checkpointed(rows)).mapInArrow(_scanner(index, first), schema)
        first = False
    return rows


def _judged(spans: DataFrame, share: int) -> DataFrame:
    hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    spans = spans.withColumn("n_hit", hit)
    return spans.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: int = SHARE, **how) -> DataFrame:
    """One row per document: key, n_words, n_hit, items, hit_from, hit_to, contaminated."""
    return _judged(hit_spans(docs, benchmark, column(docs, id_col), **how), share).drop("bytes")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, a, b in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = text.as_py()
            if a:
                _, starts, ends = _scan(text)
                edges = [0, *(x for i, j in zip(a, b) for x in (int(starts[i]), int(ends[j - 1]))), len(text)]
                text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            kept.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["key", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents",
                  share: int = SHARE, **how) -> DataFrame:
    """docs without its contaminated documents (remove="documents"), or with their hit words cut out (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    everything = F.struct(*[column(docs, c) for c in docs.columns])
    judged = _judged(hit_spans(docs, benchmark, everything, text_col=text_col, **how), share)
    if remove == "documents":
        return judged.filter("not contaminated").select("key.*")
    kind = judged.schema["key"].dataType.simpleString()
    cut = judged.select("key", "bytes", F.when(F.col("contaminated"), F.col("hit_from")).alias("a"), F.when(
        F.col("contaminated"), F.col("hit_to")).alias("b")).mapInArrow(_cut, f"key {kind}, text string")
    text = free_name(docs, "cut_text")
    flat = cut.select("key.*", F.col("text").alias(text))
    return flat.select(*[F.when(column(flat, c).isNotNull(), F.col(text)).alias(c) if c == text_col else column(flat, c) for c in docs.columns])


def items_digest(items) -> Column:
    """SHA-256 of the item ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
