"""Periodic runs against their definition, and the query against its contract worked out row by row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from liftline.llm import periodic, queries


def random_texts(seed: int) -> list[list[str]]:
    rng, texts = random.Random(seed), []
    for _ in range(60):
        words: list[str] = []
        for _ in range(rng.randrange(5)):
            kind, size = rng.randrange(4), rng.choice([1, 2, 3, 7, 8, 9, 10, 16, 17, 24, 33])
            if kind == 0:
                words += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]
            elif kind == 1:
                block = [rng.choice("ab") for _ in range(size)]
                words += (block * 12)[:rng.randrange(size * 2, size * 8)]
            elif kind == 2:  # a block that holds a repeated passage, repeated: short lags inside long periods
                part = [f"p{j}" for j in range(size)]
                words += (part + part + ["x"] + part + ["y"]) * rng.randrange(1, 5)
            else:
                words += [rng.choice("ab") for _ in range(rng.randrange(60))]
        texts.append(words)
    return texts + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, [f"u{i}" for i in range(9)] * 3, ([f"u{i}" for i in range(9)] * 3)[:26]]


@pytest.mark.parametrize("least, repeats", [(24, 3), (6, 3), (1, 3), (10, 4), (25, 3)])
def test_runs_by_definition(least, repeats):
    for seed in range(4):
        texts = random_texts(seed)
        names: dict[str, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for t in texts for w in t], dtype=np.int64)
        edges = np.cumsum([0, *map(len, texts)])
        wanted = [(int(edges[j]) + a, n, q) for j, t in enumerate(texts) for a, n, q in periodic.runs_by_definition(t, least, repeats)]
        assert periodic.runs_of(ids, edges, least, repeats) == wanted and len(wanted) > 10


def test_classes_cover_all_periods_with_grams_no_shorter_than_the_period():
    for least, repeats in ((24, 3), (1, 3), (10, 4), (100, 5)):
        classes = list(periodic.period_classes(1000, least, repeats))
        assert [q for low, high, _ in classes for q in range(low, high + 1)][:1000] == list(range(1, 1001))
        for low, high, k in classes:
            assert k == min(max(least, repeats * q) - q for q in range(low, high + 1)) and k >= high
        assert [c[2] for c in classes] == sorted(c[2] for c in classes)


def replanted(words: list[str], doc) -> list[str]:
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(t) for t in random_texts(7)] + [None, "", " \n", "é x y " * 30, "a\tb\x0bc\x0c" * 30]
    rows = [(i, texts[i % len(texts)], "x", 1) for i in range(300)] + [(5, texts[5], "x", 1)] * 2 + [(None, texts[3], "x", 1), (None, None, "x", 1)]
    rows.append((1000, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30000)) + " z" * 40000, "x", 1))
    spark.createDataFrame(rows, "doc_id long, text string, runs string, best long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                  for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    wanted = []
    for doc, text, *_ in rows:
        words = replanted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc)
        runs = periodic.runs_by_definition(words) if len(words) < 2000 else [(30000, 40000, 1)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        wanted.append((doc, len(words), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                       digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(wanted, key=str) and sum(r[2] for r in got) > 100
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic.periodic_runs(empty).count() == 0


def test_long_text_of_one_word():
    ids = np.zeros(2_000_000, dtype=np.int64)
    assert periodic.runs_of(ids, np.array([0, len(ids)])) == [(0, len(ids), 1)]
