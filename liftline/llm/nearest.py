"""Exact top-k search by inner product with vector-approximation files.

Vectors are compared as whole numbers, floor(scale * x). They are written once, in shelves of at most ``COMPONENTS``
numbers, as two files: approximations (per component the number of its cell, ``CELLS`` cells of about equal filling per
shelf and component, with the least and the greatest number in each) and exact vectors. A query's score with a vector
lies between bounds that follow from the cells alone.

The first pass scans approximations only and keeps each query's k greatest lower bounds; the kth of all shelves is a
score that its result surely reaches. The second pass scans approximations again, keeps the vectors whose upper bound
reaches that score, and reads their exact vectors in the order of upper bounds, until no bound left reaches the kth
score found. (Scores are similarities, so the greatest upper bound is what the least distance bound is to distances.)
Nothing is estimated: cells are made of all vectors, and results equal those of a full comparison.

Both passes are one group per shelf and block of queries, ``BLOCK`` queries at most, so work and memory of a task are
bounded and no key decides where a vector goes. A row of the result of a shelf is one of its k best for a query.

The query set is every row for which ``queries`` holds. Vectors that are null or hold null, NaN or infinity take no part,
nor do rows with a null id. Only vectors of equal length are compared; vectors without components have score 0 with one
another. A row is not compared with rows of its own id. Rows that repeat take a rank each, and as queries have a result
each. Ties go to the smaller id. Empty tables give empty results. Numbers whose scores may exceed 2 ** 50 raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.frames import checkpointed, column, stored

TOP, CELLS, COMPONENTS, BLOCK, TILE = 20, 16, 1 << 22, 1 << 14, 128
#: Rows of 20 bytes that are broadcast at most: one for each shelf or block of queries.
NAMES = 1 << 21


def cells_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every number, and the least and the greatest number of each component's cells."""
    n, dim = numbers.shape
    ranked, cells = np.sort(numbers, axis=0), np.empty((n, dim), dtype=np.uint8)
    least, most = np.zeros((CELLS, dim)), np.zeros((CELLS, dim))
    for d in range(dim):
        cuts = ranked[[n * j // CELLS for j in range(1, CELLS)], d]
        cells[:, d] = np.searchsorted(cuts, numbers[:, d], side="right")
        edges = [0, *np.searchsorted(ranked[:, d], cuts, side="left").tolist(), n]
        for c, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                least[c, d], most[c, d] = ranked[a, d], ranked[b - 1, d]
    return cells, least, most


def packed(cells: np.ndarray) -> bytes:
    """Two cells a byte."""
    even = np.zeros((len(cells), -(-cells.shape[1] // 2) * 2), dtype=np.uint8)
    even[:, :cells.shape[1]] = cells
    return (even[:, ::2] | even[:, 1::2] << 4).tobytes()


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    pairs = np.frombuffer(data, dtype=np.uint8).reshape(n, -(-dim // 2))
    cells = np.empty((n, 2 * pairs.shape[1]), dtype=np.uint8)
    cells[:, ::2], cells[:, 1::2] = pairs & 15, pairs >> 4
    return cells[:, :dim]


def _numbers(batch: pa.RecordBatch, at: int, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vector length, rows, whole numbers) of a batch whose column at holds vectors."""
    lists = batch.column(at)
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and not np.abs(flat).max() < 1 << 31:
        raise ValueError("vectors hold numbers of 2 ** 31 or more")
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)].astype(np.int32)


def _gathered(scale: float, most: Callable[[int], int], others: int, pack) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of vectors of one length from batches of some columns of numbers and, last, the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        name = TaskContext.get().partitionId() << 32

        def made(dim: int) -> pa.RecordBatch:
            nonlocal name
            name += 1
            parts = held.pop(dim)
            return pack(name, dim, *(np.concatenate([p[i] for p in parts]) for i in range(others + 1)))

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(others)]
            for dim, rows, numbers in _numbers(batch, others, scale):
                while len(rows):
                    room = most(dim) - sum(len(p[-1]) for p in held.get(dim, ()))
                    held.setdefault(dim, []).append((*(c[rows[:room]] for c in columns), numbers[:room]))
                    if len(rows) >= room:
                        yield made(dim)
                    rows, numbers = rows[room:], numbers[room:]
        for dim in list(held):
            yield made(dim)
    return run


def _shelf(name: int, dim: int, ids: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    cells, least, most = cells_of(numbers)
    columns = dict(shelf=name, dim=dim, ids=ids.astype(np.int64).tobytes(), cells=packed(cells), least=least.tobytes(), most=most.tobytes(),
                   numbers=numbers.tobytes())
    return pa.RecordBatch.from_pylist([columns], schema=pa.schema(
        [("shelf", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "cells", "least", "most", "numbers"))]))


def _block(name: int, dim: int, queries: np.ndarray, ids: np.ndarray, sure: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    columns = dict(block=name, q_dim=dim, queries=queries.astype(np.int64).tobytes(), q_ids=ids.astype(np.int64).tobytes(),
                   sure=sure.astype(np.float64).tobytes(), q_numbers=numbers.tobytes())
    return pa.RecordBatch.from_pylist([columns], schema=pa.schema(
        [("block", pa.int64()), ("q_dim", pa.int32()), *((c, pa.binary()) for c in ("queries", "q_ids", "sure", "q_numbers"))]))


class _Pair:
    """A shelf and a block of queries, as read from their rows."""

    def __init__(self, left: pa.Table, right: pa.Table) -> None:
        shelf, block = left.to_pylist()[0], right.to_pylist()[0]
        self.dim, self.ids = shelf["dim"], np.frombuffer(shelf["ids"], dtype=np.int64)
        self.queries, self.q_ids = (np.frombuffer(block[c], dtype=np.int64) for c in ("queries", "q_ids"))
        self.sure = np.frombuffer(block["sure"], dtype=np.float64)
        self.q = np.frombuffer(block["q_numbers"], dtype=np.int32).reshape(len(self.queries), self.dim).astype(np.float64)
        self.numbers = np.frombuffer(shelf["numbers"], dtype=np.int32).reshape(len(self.ids), self.dim) if "numbers" in shelf else None
        least, most = (np.frombuffer(shelf[c], dtype=np.float64).reshape(CELLS, self.dim) for c in ("least", "most"))
        largest = max(np.abs(least).max(initial=0), np.abs(most).max(initial=0)) * np.abs(self.q).max(initial=0) * self.dim
        if largest >= 1 << 50:  # below, all sums of halves are exact
            raise ValueError("scores may exceed 2 ** 50")
        cells, each = unpacked(shelf["cells"], len(self.ids), self.dim), np.arange(self.dim)
        self.middle, self.reach = ((least + most) / 2)[cells, each].T, ((most - least) / 2)[cells, each].T
        self.order = np.argsort(self.ids, kind="stable")

    def bounds(self, upper: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Tile by tile (first query, bounds of the scores with all vectors); minus infinity with rows of the query's own id."""
        ranked = self.ids[self.order]
        for at in range(0, len(self.q), TILE):
            q = self.q[at:at + TILE]
            spread = np.abs(q) @ self.reach
            bound = q @ self.middle
            bound = bound + spread if upper else bound - spread
            a, b = (np.searchsorted(ranked, self.q_ids[at:at + TILE], side=s) for s in ("left", "right"))
            for i in np.flatnonzero(a < b).tolist():
                bound[i, self.order[a[i]:b[i]]] = -np.inf
            yield at, bound


def lower_bounds(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shelf's k greatest lower bounds of each query's scores."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = _Pair(left, right)
        queries, lows = [], []
        for at, bound in pair.bounds(upper=False):
            if bound.shape[1] > k:
                bound = np.partition(bound, -k, axis=1)[:, -k:]
            i, j = np.nonzero(bound > -np.inf)
            queries.append(pair.queries[at + i])
            lows.append(bound[i, j])
        return pa.table({"query": np.concatenate(queries), "low": np.concatenate(lows)})
    return run


def search(upper: np.ndarray, sure: float, numbers: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, vectors read) of the k best vectors: exact vectors are read by descending upper bounds of at least
    sure, until none left can be among the k best."""
    order = np.flatnonzero(upper >= max(sure, -np.finfo(float).max))
    order = order[np.argsort(-upper[order], kind="stable")]
    scores, at, step = np.empty(0), 0, 4 * k
    while at < len(order) and not (len(scores) >= k and upper[order[at]] < np.partition(scores, -k)[-k]):
        scores = np.concatenate([scores, numbers[order[at:at + step]] @ q])
        at, step = at + step, 2 * step
    read = order[:len(scores)]
    best = np.lexsort((ids[read], -scores))[:k]
    return ids[read[best]], scores[best], len(read)


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = _Pair(left, right)
        queries, ids, scores = [], [], []
        for at, bound in pair.bounds(upper=True):
            for i, row in enumerate(bound, at):
                found, score, _ = search(row, pair.sure[i], pair.numbers, pair.ids, pair.q[i], k)
                queries.append(np.full(len(found), pair.queries[i]))
                ids.append(found)
                scores.append(score.astype(np.int64))
        return pa.table({"query": np.concatenate(queries), "id": np.concatenate(ids), "score": np.concatenate(scores)})
    return run


def _met(shelves: DataFrame, blocks: DataFrame, run, schema: str) -> DataFrame:
    """run(shelf, block) of every shelf with every block of queries of the same vector length."""
    def names(frame: DataFrame, name: str, dim: str) -> DataFrame:
        frame = frame.select(F.col(name).alias("other"), F.col(dim).alias("other_dim"))
        return F.broadcast(frame) if frame.count() <= NAMES else frame

    left = shelves.join(names(blocks, "block", "q_dim"), F.col("dim") == F.col("other_dim")).drop("other_dim")
    right = blocks.join(names(shelves, "shelf", "dim"), F.col("q_dim") == F.col("other_dim")).drop("other_dim")
    return left.groupBy("shelf", "other").cogroup(right.groupBy("other", "block")).applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding",
          components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """query (id), rank from 1, id, score: for each row that queries selects, its k best rows. Ids are longs."""
    vec = column(vectors, vec_col)
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(F.exists("vec", odd), F.lit(False)))
    room = lambda dim: max(1, components // max(dim, 1))

    shelves = stored(rows.select("id", "vec").mapInArrow(
        _gathered(scale, room, 1, _shelf), "shelf long, dim int, ids binary, cells binary, least binary, most binary, numbers binary"))
    asked = checkpointed(rows.filter("asks").select(F.monotonically_increasing_id().alias("query"), "id", "vec"))
    parts = max(1, -(-asked.count() // block))

    def blocks(frame: DataFrame) -> DataFrame:
        frame = frame.select("query", "id", "sure", "vec").repartition(parts)
        return checkpointed(frame.mapInArrow(_gathered(scale, lambda dim: block, 3, _block),
                                             "block long, q_dim int, queries binary, q_ids binary, sure binary, q_numbers binary"))

    lows = _met(shelves.drop("numbers"), blocks(asked.withColumn("sure", F.lit(float("-inf")))), lower_bounds(k), "query long, low double")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    sure = checkpointed(lows.withColumn("n", F.row_number().over(by_low)).filter(F.col("n") <= k).filter(F.col("n") == k).select("query", "low"))
    surely = asked.join(sure, "query", "left").withColumn("sure", F.coalesce("low", F.lit(float("-inf"))))
    found = _met(shelves, blocks(surely), _best(k), "query long, id long, score long")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return best.join(asked.select("query", F.col("id").alias("asking")), "query").select(F.col("asking").alias("query"), "rank", "id", "score")
