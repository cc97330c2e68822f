"""The conversation trie against all prefixes written out, in bands and shards of several sizes, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from liftline.llm import queries, trie
from liftline.llm.frames import numbered

SCHEMA = "conv_id long, turn int, role string, text string, path string, key int"
COLUMNS = ("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha")


def ordered(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}


def brute(convs: dict[int, list]) -> list[tuple]:
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, ms in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(ms) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, ms in members.items()), key=str)


def random_rows(seed, convs, turns, words):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        c = c * 3 - 20
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, ["user", "assistant"][t % 2], "é" * rng.randrange(words), "x", 1))
    rows += [(900 + i, t, "user", "same", "x", 1) for i in range(60) for t in range(3)]  # copies
    rows += [(2000, None, "user", "first", "x", 1), (2000, 0, None, "b", "x", 1), (2000, 0, "user", "a", "x", 1), (2000, 0, "user", "a", "x", 1),
             (2001, 0, "user", None, "x", 1), (2002, 0, "user", "", "x", 1), (None, 0, "user", "a", "x", 1), (2003, 0, "", "user", "x", 1),
             (2004, 0, "user:", "", "x", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band, shard", [(trie.BAND, 40), (3, 25), (1, 60)])
def test_trie(spark, band, shard):
    rows = random_rows(1, 70, 9 if band > 1 else 5, 3)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), band=band, shard=shard)
    assert got.columns == list(COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ordered(rows))


def test_query(spark, tmp_path):
    rows = [(c + 20 if c is not None and c < 900 else c, *rest) for c, *rest in random_rows(2, 60, 14, 4)]
    rows += [(3001 + 5 * i, 0, "user", "alone", "x", 1) for i in range(12)]  # no base conversation: turnless if they lose their only turn
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered(rows)
    rebuilt = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + turns[zlib.crc32(str(c).encode()) % 9:] for c, turns in own.items()}
    assert any(not seq for seq in rebuilt.values())
    got = queries.op13_conversation_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rebuilt)


def test_empty_table_and_null_ids(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "a", "x", 1)], SCHEMA)).count() == 0


def test_a_conversation_in_many_pieces_and_a_hot_ending(spark):
    turns = spark.range(3000).select(F.lit(7).cast("long").alias("conv"), F.col("id").alias("turn"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"),
                                     F.lit(1).cast("long").alias("bytes"))
    assert [(r["pos"], r["key"]) for r in numbered(turns, ["conv"], [F.col("turn")]).orderBy("pos").collect()] == [(r["turn"], r["key"]) for r in turns.orderBy("turn").collect()]
    ends = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).cast("long").alias("ending"), F.col("id").alias("conv"))
    got = {r["ending"]: r["sha"] for r in trie.digests(ends, piece=7).collect()}
    assert got[0] == hashlib.sha256(",".join(map(str, range(900))).encode()).hexdigest() and got[950] == hashlib.sha256(b"950").hexdigest() and len(got) == 101


def test_medians_first_balances_siblings():
    tree = trie.TernaryTree()
    for i in trie.medians_first(1023):
        tree.insert([0, i], [0, 1], 1, i, {})
    depth, stack = 0, [(tree.equal[0], 1)]
    while stack:
        at, d = stack.pop()
        if at >= 0:
            depth = max(depth, d)
            stack += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert depth == 10 and sorted(trie.medians_first(50)) == list(range(50))
