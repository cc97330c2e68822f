"""Reply order: every message's answer, thread, depth and place against a version that looks at all messages."""

from __future__ import annotations

import importlib.util
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from liftline.llm import quotes

SCHEMA = "conv_id long, turn int, role string, text string, depth int"


def brute(rows):
    """(conv, turn) -> to, by_quote, root, depth, position."""
    parsed = [(c, t, *quotes.parse(x or "")) for c, t, _, x, *_ in rows if c is not None and t is not None]
    own: dict[int, set] = {}
    for c, t, _, _, mine in parsed:
        for h in mine:
            own.setdefault(h, set()).add((c, t))
    places = {(c, t) for c, t, *_ in parsed}
    links: dict[tuple, list] = {}
    for c, t, _, quoted, _ in parsed:
        for rank, h, short in quoted:
            before = [u for d, u in own.get(h, ()) if d == c and u < t]
            if before:
                links.setdefault((c, t), []).append((False, rank, -max(before), c))
            elif not short and own.get(h) and min(own[h])[0] < c:
                d, u = min(own[h])
                links.setdefault((c, t), []).append((True, rank, -u, d))
    to, quoted = {}, {}
    for c, t in places:
        best = min(links.get((c, t), []), default=None)
        earlier = [u for d, u in places if d == c and u < t]
        to[c, t] = (best[3], -best[2]) if best else (c, max(earlier)) if earlier else None
        quoted[c, t] = best is not None
    out = {}
    for p in places:
        chain = [p]
        while to[chain[-1]]:
            chain.append(to[chain[-1]])
        out[p] = (to[p], quoted[p], chain[-1], len(chain) - 1)
    order = sorted(places, key=lambda p: (out[p][2], out[p][3], p))
    count: dict[tuple, int] = {}
    for p in order:
        count[out[p][2]] = count.get(out[p][2], -1) + 1
        out[p] += (count[out[p][2]],)
    return out


def threads(seed, convs, turns):
    rng, rows, said = random.Random(seed), [], []
    words = [f"word{i}" for i in range(60)]
    for c in range(convs):
        turn, here = 0, []
        for _ in range(rng.randrange(1, turns)):
            own = " ".join(rng.choices(words, k=rng.randrange(1, 7))) if rng.random() > 0.2 else rng.choice(["Yes.", "I agree.", "ok"])
            lines = []
            pool = here + rng.sample(said, min(len(said), 3))
            for level in range(1, rng.choice([1, 1, 2, 3])):
                if pool:
                    lines.append(">" * level + " " + rng.choice(pool).upper())
            rows.append((c, turn, "user", "\n".join([*(["On Monday, x wrote:"] if lines else []), *lines, own]), 1))
            here.append(own)
            said.append(own)
            turn += rng.choice([1, 1, 1, 2, 5])
        if rng.random() > 0.7 and turn:
            rows.append((c, rows[-1][1], "user", "a second message of that turn", 1))
    rows += [(900, t, "user", f"long chain {t}", 1) for t in range(70)] + [(None, 1, "user", "> Yes.", 1), (3, None, "user", "x", 1), (901, 0, None, None, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_reply_order_against_brute_force(spark, seed):
    rows = threads(seed, 40, 12)
    wanted = brute(rows)
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        if r["conv"] is None or r["turn"] is None:
            assert [r[c] for c in ("to_conv", "to_turn", "by_quote", "thread_conv", "thread_turn", "depth", "position")] == [None, None, False, None, None, None, None]
            continue
        to = None if r["to_conv"] is None else (r["to_conv"], r["to_turn"])
        seen[r["conv"], r["turn"]] = (to, r["by_quote"], (r["thread_conv"], r["thread_turn"]), r["depth"], r["position"])
    assert seen == wanted
    for p, (to, _, root, depth, position) in seen.items():  # parents first, in every thread
        assert to is None or (seen[to][2] == root and seen[to][3] == depth - 1 and seen[to][4] < position)
    assert sum(v[1] for v in seen.values()) > 25 and max(v[3] for v in seen.values()) >= 69


def test_a_gap_and_a_branch(spark):
    texts = {0: "How do I cook rice?", 1: "With a lot of water.", 2: "Thanks.", 3: "> With a lot of water.\nHow much?", 5: "A litre.", 6: "> How much?\n> Thanks.\nYes."}
    frame = spark.createDataFrame([(7, t, "x", x, 1) for t, x in texts.items()], SCHEMA)
    linked = quotes.link_quotes(frame)
    got = {r["turn"]: (r["to_turn"], r["depth"], r["position"], r["by_quote"]) for r in linked.collect()}
    assert got == {0: (None, 0, 0, False), 1: (0, 1, 1, False), 2: (1, 2, 2, False), 3: (1, 2, 3, True), 5: (3, 3, 4, False), 6: (3, 3, 5, True)}
    assert [r["turn"] for r in quotes.in_reply_order(linked).collect()] == [0, 1, 2, 3, 5, 6]
    assert quotes.link_quotes(frame.limit(0)).count() == 0


def test_conversations_over_several_pieces(spark):
    rng = random.Random(5)
    rows = threads(3, 30, 10) + [(950, t, "user", f"> long chain {rng.randrange(70)}\nanswer {t}" if t % 9 == 4 else f"> answer {t - 9}" if t % 9 == 6 else f"said {t}", 1)
                                 for t in range(90)]
    wanted = brute(rows)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        messages = spark.createDataFrame(rows, SCHEMA)
        pieces = quotes._dealt(messages.filter("conv_id = 950"), ["conv_id", "turn"]).select("piece").distinct().count()
        got = {(r["conv"], r["turn"]): ((r["to_conv"], r["to_turn"]) if r["to_conv"] is not None else None, r["by_quote"], (r["thread_conv"], r["thread_turn"]), r["depth"], r["position"])
               for r in quotes.link_quotes(messages).collect() if r["conv"] is not None and r["turn"] is not None}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert pieces > 5 and got == wanted


CLUSTER = """
import sys, time
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[2])
from liftline.llm import quotes
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.executor.memory": "1g",
    "spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared", "spark.sql.warehouse.dir": sys.argv[1] + "/tables"}).getOrCreate()
rows = spark.createDataFrame([(c, t, "user", f"message {c} {t}") for c in range(40) for t in range(5)], "conv_id long, turn int, role string, text string")
for n in range(2):
    quotes.link_quotes(rows).write.parquet(f"{sys.argv[1]}/out{n}")
end = time.time() + 10
while (left := spark.sparkContext.statusTracker().getActiveStageIds()) and time.time() < end:
    time.sleep(0.2)
print("left", list(left), flush=True)
"""


def test_no_stage_outlives_its_query(tmp_path):
    """Executors of their own, no quotes: stages that a query has left behind would hold cores until a time limit."""
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors work below Spark's home
        if p.name != "work":
            (tmp_path / "home").mkdir(exist_ok=True)
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), str(Path(__file__).resolve().parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.split("\n")[-2:] == ["left []", ""], done.stdout + done.stderr[-2000:]
