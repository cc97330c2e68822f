"""Exact top-k against a full comparison, the pruning itself, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftline.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<float>, query int, id string, score string"


def brute(rows, asks, k, scale):
    ok = [(i, [math.floor(scale * x) for x in map(np.float64, map(np.float32, v))]) for i, v, *_ in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if asks(i):
            found = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def odd_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.15, (8, dim))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.1, dim)).tolist(), 1, "x", "y") for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1, None, "y") for i in range(40)]  # ties, among them queries
    rows += [(n + 50, None, 1, "x", "y"), (None, same, 1, "x", "y"), (n + 60, [], 1, "x", "y"), (n + 80, [], 1, "x", "y"), (n + 81, [0.5], 1, "x", "y"),
             (n + 100, [None] + same[1:], 1, "x", "y"), (n + 120, [float("nan")] + same[1:], 1, "x", "y"),
             (n + 140, [float("inf")] + same[1:], 1, "x", "y"), (n + 160, [-0.001] * dim, 1, "x", "y"), rows[20], rows[20]]
    random.Random(seed).shuffle(rows)
    return rows


def results(frame):
    return sorted(tuple(r) for r in frame.select("query", "rank", "id", "score").collect())


@pytest.mark.parametrize("k, components, block", [(20, nearest.COMPONENTS, nearest.BLOCK), (3, 7 * 30, 5), (500, 7 * 100, 1000)])
def test_top_k(spark, k, components, block):
    rows = odd_rows(260, 7, 1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = nearest.top_k(frame, F.col("vec_id") % 20 == 0, k, 64, components=components, block=block)
    assert got.columns == ["query", "rank", "id", "score"]
    assert results(got) == brute(rows, lambda i: i % 20 == 0, k, 64)


def test_query_and_empty_tables(spark, tmp_path):
    rows = odd_rows(100, 6, 2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op12_exact_top_k(spark, str(tmp_path)).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, 20, 64)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert nearest.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.top_k(frame, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_spare_most_exact_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (20, 32))
    numbers = np.floor(centres[rng.integers(0, 20, 5000)] + rng.normal(0, 4, (5000, 32))).astype(np.int32)
    cells, least, most = nearest.cells_of(numbers)
    each = np.arange(32)
    assert (least[cells, each] <= numbers).all() and (numbers <= most[cells, each]).all()
    assert (nearest.unpacked(nearest.packed(cells), 5000, 32) == cells).all() and np.bincount(cells.ravel(), minlength=16).min() > 4000
    odd = numbers[:, :5]
    assert (nearest.unpacked(nearest.packed(cells[:, :5]), 5000, 5) == cells[:, :5]).all() and odd.shape == (5000, 5)
    read = 0
    for q in numbers[:50].astype(float):
        upper = np.maximum(q * least[cells, each], q * most[cells, each]).sum(axis=1)
        ids, scores, n = nearest.search(upper, -np.inf, numbers, np.arange(5000), q, 20)
        exact = numbers @ q
        assert (exact <= upper).all() and scores.tolist() == sorted(exact.tolist())[::-1][:20]
        read += n
    assert read < 0.15 * 50 * 5000


def test_scores_that_do_not_fit(spark):
    frame = spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2 \\*\\* 50"):
        nearest.top_k(frame, F.col("vec_id") == 0).collect()
