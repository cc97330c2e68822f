"""The pipeline as a whole against its stages worked out in plain Python, on a small corpus with odd rows."""

from __future__ import annotations

import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from liftline.llm import exact, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,string>"
ITEM = "the seventh question asks how many green apples remain in the old wooden box after lunch"


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def corpus():
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(420):
        toxic = i % 6 == 0
        text = " ".join(rng.choices(words, k=rng.randrange(20, 60)) + (["vile", "slur"] if toxic else []))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    base = " ".join(rng.choices(words, k=400))
    rows += [(1000 + i, base) for i in range(5)] + [(1010, base.upper())]
    for i in range(4):
        near = base.split()
        near[rng.randrange(400)] = f"n{i}"
        rows.append((1020 + i, " ".join(near)))
    rows += [(1100, " ".join(rng.choices(words, k=10)) + " " + ITEM), (1101, " ".join(rng.choices(words, k=30)) + " " + ITEM.upper()),
             (1200, None), (1201, ""), (1202, " "), (None, "without an id"), (None, "without an id"), (1203, " ".join(rng.choices(words, k=9000)))]
    rng.shuffle(rows)
    return rows, labels


def kept_by_definition(rows, labels, score):
    rows = [r for r in rows if score(r[1]) < 0.7]
    best: dict[str, tuple] = {}
    for r in rows:  # the largest id of equal texts
        t = low(r[1])
        if t not in best or (r[0] is not None and (best[t][0] is None or r[0] > best[t][0])):
            best[t] = r
    rows = list(best.values())

    def print_of(text):
        words = re.findall(r"[^ \t-\r]+", low(text))
        grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    first = {}
    for g, r in zip(group, rows):
        if g not in first or (r[0] is not None and (first[g][0] is None or r[0] < first[g][0])):
            first[g] = r
    item = re.findall("[0-9a-z]+", ITEM)
    windows = {tuple(item[i:i + 13]) for i in range(len(item) - 12)}
    out = []
    for i, t in first.values():
        words, hit = re.findall("[0-9a-z\x80-\U0010ffff]+", low(t)), set()
        for j in range(len(words) - 12):
            if tuple(words[j:j + 13]) in windows:
                hit.update(range(j, j + 13))
        if not (hit and 20 * len(hit) >= len(words)):
            out.append(i)
    return out


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels = corpus()
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), {"a": "b"}) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q7", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    texts = dict(rows)
    seen: dict[bytes, list] = {}
    for i, y in known.items():
        seen.setdefault(toxicity.terms(texts[i]).tobytes(), []).append(float(y))
    ordered = sorted(seen.items())
    machine = toxicity.fit([np.frombuffer(x, np.int32) for x, _ in ordered], np.array([np.mean(y) for _, y in ordered]))
    wanted = kept_by_definition(rows, labels, lambda t: machine.score(toxicity.terms(t)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in got}, key=str) == sorted(set(wanted), key=str)
    gone = {i for i, _ in rows} - set(wanted)
    assert {i for i in range(0, 420, 6)} <= gone and len(gone & {i for i in range(420) if i % 6}) == 0
    assert {1100, 1101} <= gone and len({i for i in wanted if i is not None and 1000 <= i < 1030}) < 4
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fill: dict[int, list] = {}
    for r in got:
        if r["doc_id"] is not None:
            ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0][r["start"]:r["start"] + r["length"]]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def test_every_stage_takes_empty_tables_and_keeps_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns)


def test_exact_copies_with_a_map_column(spark):
    frame = spark.createDataFrame([(1, "a", {"x": "y"}), (1, "a", {"x": "z"}), (2, "A", {})], "doc_id long, text string, m map<string,string>")
    assert [r["doc_id"] for r in exact.drop_duplicates(frame).collect()] == [2]
