"""SimHash near-duplicates with pigeonring filtering.

``fingerprints`` gives each text a 64-bit SimHash over its word shingles. ``links`` joins distinct fingerprints that
differ in at most ``max_bits`` bits. It cuts a fingerprint into a ring of segments. If two fingerprints differ in at
most t bits over m segments, some chain of consecutive segments exists in which every beginning of length l differs in
at most l * t / m bits. All but the last segment of such a chain have at most t - 1 differing segments, at places that
the budgets allow; the rest are equal and serve as join key. Candidates must then pass the chain test on their
differing bits, then the full count.

A key that more than ``CROWD`` fingerprints share gives no pairs. Its fingerprints are linked exactly through
midpoints instead: two fingerprints at most two bits apart have a common neighbour at most one bit from each, and all
neighbours of one value are within two bits of each other, so each links to the smallest: 65 rows per fingerprint,
however large the crowd.

``drop_near_duplicates`` keeps one document of each group that links connect.

Null texts count as empty: fingerprint zero, linked like any other. A null doc_id is carried through, and is no
component's smallest id while another id is there. Repeated rows have one result each; where documents are dropped, rows
of one id and text stay or go together. Empty tables give empty results. Other columns are kept where documents are
dropped, and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.components import components
from liftline.llm.exact import row_key
from liftline.llm.frames import checkpointed, column, free_name

SHINGLE, MAX_BITS, RING, CROWD, SEED = 3, 2, 6, 64, 42
_MASK = (1 << 64) - 1
_COUNTED = 1 << 17


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words; of fewer words: of all of them."""
    parts = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1).tolist()
    starts = [0, *ends]
    if len(parts) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    return np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])), np.uint64, len(parts) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at:at + _COUNTED]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprinter(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(majority(shingle_hashes(t.as_py() or b"", shingle))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc", "print"])
    return run


def _texts(docs: DataFrame, key: Column, text_col: str) -> DataFrame:
    return docs.select(key.alias("doc"), F.encode(column(docs, text_col), "UTF-8").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc, print: the fingerprint as a signed 64-bit integer."""
    rows = _texts(docs, column(docs, id_col), text_col)
    return rows.mapInArrow(_fingerprinter(shingle), f"doc {rows.schema['doc'].dataType.simpleString()}, print long")


def segment_masks(ring: int) -> list[int]:
    """The bits of each segment of the ring, of as equal sizes as can be."""
    edges = [64 * i // ring for i in range(ring + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def key_masks(max_bits: int, ring: int) -> list[int]:
    """The bits that agree on some chain of ring - 1 segments, for each way to spend the chain's budget."""
    segments, masks = segment_masks(ring), set()
    for start in range(ring):
        chain = [(start + j) % ring for j in range(ring - 1)]
        budget = (ring - 1) * max_bits // ring
        for spent in combinations(range(ring - 1), budget):
            if all(sum(j < l for j in spent) <= l * max_bits // ring for l in range(1, ring)):
                masks.add(sum(segments[s] for j, s in enumerate(chain) if j not in spent))
    return sorted(masks)


def chain_passes(difference: Column, max_bits: int, ring: int) -> Column:
    """Some chain of segments keeps its cumulative differing bits within its proportional budgets at every length."""
    counts = [F.bit_count(difference.bitwiseAND(F.lit(_signed(m)))) for m in segment_masks(ring)]
    chains = []
    for start in range(ring):
        sums = [reduce(lambda a, b: a + b, [counts[(start + j) % ring] for j in range(l)]) for l in range(1, ring + 1)]
        chains.append(reduce(lambda a, b: a & b, [s <= l * max_bits // ring for l, s in enumerate(sums, 1)]))
    return reduce(lambda a, b: a | b, chains)


def links(prints: DataFrame, max_bits: int = MAX_BITS, ring: int = RING, crowd: int = CROWD) -> DataFrame:
    """prints (distinct fingerprints in column print) -> edges a, b that connect just the fingerprints linked by
    differences of at most max_bits (0 to 2) bits. Between small keys' members every linked pair is an edge."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).filter("false")
    masks = F.array(*[F.lit(_signed(m)) for m in key_masks(max_bits, ring)])
    keyed = prints.select("print", F.posexplode(masks).alias("which", "mask")).select(
        "which", F.col("print").bitwiseAND(F.col("mask")).alias("bits"), "print")
    sizes = keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    met = checkpointed(keyed.join(sizes, ["which", "bits"]))
    few = met.filter(F.col("n") <= crowd)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = few.withColumnRenamed("print", "a").join(few.select("which", "bits", F.col("print").alias("b")), ["which", "bits"])
    pairs = pairs.filter("a < b").filter(chain_passes(differ, max_bits, ring)).filter(F.bit_count(differ) <= max_bits)
    crowded = met.filter(F.col("n") > crowd).select("print").distinct()
    if max_bits == 2:
        middles = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
        around = crowded.select("print", F.explode(middles).alias("bit")).select("print", F.lit(0).alias("which"), F.col("print").bitwiseXOR(F.col("bit")).alias("middle"))
    else:
        around = crowded.select("print", F.posexplode(F.array(*[F.lit(_signed(1 << i)) for i in range(64)])).alias("which", "bit")).select(
            "print", "which", F.col("print").bitwiseAND(F.bitwise_not("bit")).alias("middle"))
    # at most 65 prints share a middle
    star = around.withColumn("b", F.min("print").over(Window.partitionBy("which", "middle"))).filter("print <> b")
    return pairs.select("a", "b").unionByName(star.select(F.col("print").alias("a"), "b")).distinct()


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """prints (doc, print) -> print, head (its smallest doc), root (the smallest print of its group): a row per print."""
    heads = checkpointed(prints.groupBy("print").agg(F.min("doc").alias("head")))
    roots = components(links(heads.select("print"), max_bits))
    return checkpointed(heads.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "head", F.coalesce("root", "print").alias("root")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc, print, component (the smallest doc reachable by links)."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    rooted = _rooted(prints, max_bits)
    smallest = rooted.groupBy("root").agg(F.min("head").alias("component"))
    named = checkpointed(rooted.join(smallest, "root").select("print", "component"))
    return prints.join(named, "print").select("doc", "print", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the document of the smallest id."""
    key, row = free_name(docs, "kept_doc"), free_name(docs, "kept_row")
    own = row_key(F.coalesce(column(docs, text_col), F.lit("")))
    named = docs.select(F.struct(column(docs, id_col).alias("id"), own.alias("row")).alias("pair"), column(docs, text_col).alias("text"))
    prints = checkpointed(fingerprints(named, "pair", "text", shingle))
    rooted = _rooted(prints, max_bits)
    # a null id is the last choice
    first = F.min(F.struct(F.col("doc.id").isNull().alias("unnamed"), F.col("doc").alias("pair")))
    heads = prints.groupBy("print").agg(first.alias("first")).join(rooted.select("print", "root"), "print")
    kept = checkpointed(heads.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.pair.id").alias(key), F.col("first.pair.row").alias(row)))
    return docs.join(kept, column(docs, id_col).eqNullSafe(F.col(key)) & (own == F.col(row)), "left_semi")


def print_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
