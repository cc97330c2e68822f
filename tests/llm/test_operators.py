"""The ten operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from liftline.llm import decontaminate, exact, html_blocks, licenses, packing, pii, quotes, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, doc string, row long, key long"
FILLER = [f"w{i}" for i in range(400)]


def prose(a: int, n: int = 60) -> str:
    return " ".join(FILLER[(a * 7 + i * 3) % 400] + str(a) for i in range(n))


TEXTS = [
    (0, prose(1)), (1, prose(1).upper()), (2, None), (3, ""), (4, " \n\t"), (5, "short text"), (6, prose(2) + " " + prose(1, 30)),
    (7, prose(1) + " End"), (8, "Éa " + prose(3)), (9, "éa " + prose(3)), (9, "éa " + prose(3)), (None, prose(4)), (None, prose(4)),
    (10, prose(5, 3000)), (11, "mail me: a.b@c.org or +1 (555) 123-4567 from 10.0.0.255, 1.2.3.256 card 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("block", [7, 8192])
def test_exact(docs, nothing, block):
    rows = exact.duplicates(docs, block_chars=block, hot_blocks=2).collect()
    assert len(rows) == len(TEXTS) and exact.duplicates(nothing).count() == 0
    groups: dict[str, list] = {}
    for i, t in TEXTS:
        groups.setdefault(hashlib.sha256(low(t).encode()).hexdigest(), []).append(i)
    for r in rows:
        ids = groups[bytes(r["sha"]).hex()]
        assert r["doc"] in ids and r["size"] == len(ids) and r["keep"] == max([i for i in ids if i is not None], default=None)
    kept = exact.drop_duplicates(docs, block_chars=block)
    assert kept.columns == docs.columns and sorted(hashlib.sha256(low(r["text"]).encode()).hexdigest() for r in kept.collect()) == sorted(groups)


def test_simhash_links(spark, docs, nothing):
    random = np.random.default_rng(3)
    seeds = random.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(seeds.tolist())
    for s in seeds[:8]:
        for _ in range(40):
            flips = random.choice(64, random.integers(1, 4), replace=False)
            prints.add(int(s) ^ sum(1 << int(f) for f in flips))
    signed = sorted(simhash._signed(p) for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & simhash._MASK).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for crowd in (2, 64):  # by midpoints, by pairs
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, crowd=crowd)).collect()}
        assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}
    found = simhash.classes(docs).collect()
    assert len(found) == len(TEXTS) and simhash.classes(nothing).count() == 0
    assert {r["component"] for r in found if r["print"] == 0} == {2}


def by_definition(text, shingle=3):
    """A fingerprint bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_near_dedup_against_brute_force(spark, docs, nothing):
    rng = random.Random(5)
    rows = list(TEXTS)
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 40, 400]))]
        for i in range(6):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{g}_{i}"
            rows.append((100 + g * 10 + i, " ".join(words)))
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    prints = [by_definition(t) for _, t in rows]
    found = sorted((str(r["doc"]), r["print"] & simhash._MASK) for r in simhash.fingerprints(frame).collect())
    assert found == sorted((str(i), p) for (i, _), p in zip(rows, prints))
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    groups: dict[int, list[tuple]] = {}
    for (i, t), g in zip(rows, group):
        groups.setdefault(g, []).append((i is None, i, t or ""))
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    wanted = []
    for members in groups.values():
        unnamed, i, t = min(members, key=lambda m: (m[0], m[1] or 0))
        wanted += [(unnamed, i or 0)] * sum(m == (unnamed, i, t) for m in members)
    assert got == sorted(wanted) and len(groups) < len(rows) - 20
    assert simhash.drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_substrings(docs, nothing, crowd):
    words = [(i, re.findall(r"[^ \t-\r]+", t or "")) for i, t in TEXTS]
    first: dict[tuple, int] = {}
    for i, w in words:
        for j in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[j:j + 13])] = min(i, first.get(tuple(w[j:j + 13]), i))
    expected = []
    for i, w in words:
        gone = {k for j in range(len(w) - 12) if i is not None and first[tuple(w[j:j + 13])] < i for k in range(j, j + 13)}
        expected.append((str(i), len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(str(r["doc"]), r["n_words"], r["kept_text"]) for r in substrings.remove_repeats(docs, crowd=crowd).collect()]
    assert sorted(got) == sorted(expected) and substrings.remove_repeats(nothing).count() == 0


def test_suffix_automaton():
    random = np.random.default_rng(1)
    texts = [[bytes([x]) for x in random.integers(97, 100, 30).tolist()] for _ in range(5)]
    automaton = substrings.SuffixAutomaton()
    for n, text in enumerate(texts):
        joined = [b"".join(t) for t in texts[:n]]
        for j, got in enumerate(automaton.statistics(text)):
            assert got == max(k for k in range(j + 2) if any(b"".join(text[j + 1 - k:j + 1]) in t for t in joined) or k == 0)
        automaton.add(text)


def test_decontamination(spark, docs, nothing):
    items = [(7, prose(1, 20)), (10, "Short, TEXT!"), (None, prose(3, 14)), (11, ""), (12, None), (13, prose(5, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    def plain(text):
        own, hit, names = words(text), set(), set()
        for item, t in items:
            theirs = words(t)
            size = min(13, len(theirs))
            for i in range(len(theirs) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j:j + size] == theirs[i:i + size]:
                        hit |= set(range(j, j + size))
                        names |= {str(item)} if item is not None else set()
        return len(own), len(hit), sorted(names)

    expected = sorted((str(i), *plain(t)) for i, t in TEXTS)
    for chars in (64_000_000, 150):  # one part, several
        got = decontaminate.contamination(docs, bench, part_chars=chars).collect()
        assert sorted((str(r["key"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got) == expected
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and not {0, 1, 5} & {r["doc_id"] for r in kept.collect()}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[5].strip() == "" and cut[2] is None and len(words(cut[0])) == 40
    assert decontaminate.contamination(nothing, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_packing(docs, nothing):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + [(20 + k, t) for k, t in enumerate(["<|endoftext|>", "<|endoftext|> after", "before <|endoftext|>", "a<|endoftext|>b  c",
                                                        "x <|endoftext|><|endoftext|> y", "é <|endoftext|>\n<|endoftext", "no < | endoftext|> mark"])]
    more = docs.sparkSession.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], SCHEMA)
    rows = packing.packed_pieces(more, sequence=64).collect()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = {(r["start"], r["length"], r["crc"]) for r in rows if r["doc"] == i}
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for a, b in zip(cuts, cuts[1:]):
            assert (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) in own
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 64
    assert packing.packed_pieces(nothing).count() == 0


def test_swaps_empty_bins():
    lengths = np.array([6, 4, 4, 3, 3, 5, 5])  # 30: three full bins, which best fit in falling length misses or swaps reach
    bins = packing.pack(lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
    random = np.random.default_rng(5)
    for _ in range(20):
        lengths = random.integers(1, 100, 200)
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(200)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
        assert len(bins) <= len(packing.best_fit(lengths, 100))


def test_word_ids():
    table = packing.word_ids(None)
    for text in ("", " ", "a  b", "a \n b", "x y  z", "it's 'm  12 é�", "<|endoftext|> a", "\n\nq w"):
        assert table.text(text) == table.whole(text)


def test_pii(docs, nothing):
    rows = {(r["doc"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in pii.spans(docs).collect()}
    text = dict(TEXTS)[11]
    at = lambda kind, s: (kind, text.index(s), text.index(s) + len(s))
    assert (11, (at("email", "a.b@c.org"), at("ip", "10.0.0.255"), at("card", "4111 1111 1111 1111"), at("phone", "+1 (555) 123-4567"))) in rows
    assert (2, ()) in rows and pii.spans(nothing).count() == 0 and pii.spans(docs).count() == len(TEXTS)
    model = pii.train([])
    assert model.kinds["email"] == 0
    counts = [("phone", (1, 1, 0, 1, 0, 1), 90), ("phone", (-1, 0, -1, 0, -1, -1), 80), ("phone", (1, 0, 0, 1, 0, 0), 9)]
    sure, never, likely = pii.estimate(counts)
    assert sure > 0.95 and never < 0.05 and likely > 0.5


def test_toxicity(spark, docs, nothing):
    random = np.random.default_rng(2)
    words = [f"q{i}z" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        insult, group = bool(random.integers(2)), bool(random.integers(2))
        text = [*random.choice(words, 12), *(["insult"] if insult else []), *(["folk"] if group else [])]
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(frame, known)
    held = [(t, y) for (i, t), (_, y) in zip(rows, labels) if spark is not None and __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(machine.score(toxicity.terms(t)) >= 0.5) == bool(y) for t, y in held]) > 0.95
    # the pair decides, and neither word alone tells anything
    either = [float(y0 != y1) for y0, y1 in (("insult" in t.split(), "folk" in t.split()) for _, t in rows)]
    examples = [toxicity.terms(t) for _, t in rows]
    accuracy = lambda m: np.mean([(m.score(x) >= 0.5) == bool(y) for x, y in zip(examples[600:], either[600:])])
    assert accuracy(toxicity.fit(examples[:600], np.array(either[:600]))) > 0.95
    assert accuracy(toxicity.fit(examples[:600], np.array(either[:600]), factors=1, epochs=0)) < 0.65
    scored = toxicity.scores(docs, machine, F.col("doc_id")).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    blank = toxicity.train(docs, known.limit(0))
    assert toxicity.scores(docs, blank, F.col("doc_id")).first()["score"] == 0.5
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and toxicity.scores(nothing, blank, F.col("doc_id")).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div id="cookie-notice">We use cookies here</div>
<div class="content"><h2>A title</h2><p>The cat sat on the mat and it was the best of the times that we had in the year for all of us, and so it goes on.</p>
<p>Short &amp; one.</p><ul><li>item<li>second</ul></div><section class="comments"><article><p>It was good to me in the end as it is, of all that we had.</p></article>
</section><form><label>Mail</label></form><footer>c</footer><script>if (a<b) {}</script>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "plain text"), (4, "w", "</div></p>x<i>y")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, page string")
    got = {r["page"]: r["text"] for r in html_blocks.main_text(frame).collect()}
    assert got[1].split("\n")[0] == "A title" and got[1].split("\n")[2:] == ["Short & one.", "item", "second"] and len(got[1].split("\n")) == 5
    assert got[2] == got[None] == "" and got[3] == "plain text" and got[4] == "xy"
    assert html_blocks.main_text(frame.limit(0)).count() == 0


def test_licenses(docs, nothing, spark):
    text = "Intro é words. Released  under the\nMIT license. More. " + licenses.TEMPLATES["Apache-2.0 notice"].replace("obtain", "get") + " end"
    frame = spark.createDataFrame([(1, text), (1, text), (None, None), (2, "the license of a car")], "doc_id long, text string")
    rows = licenses.license_spans(frame).collect()
    assert sorted({(r["doc"], r["license"]) for r in rows}) == [(1, "Apache-2.0 notice"), (1, "MIT")] and len(rows) == 4
    mit = next(r for r in rows if r["license"] == "MIT")
    assert text[mit["start"]:mit["end"]] == "Released  under the\nMIT license" and mit["coverage"] == 1
    assert licenses.license_spans(nothing).count() == 0 and licenses.license_spans(docs, templates={}).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "a", "What is the best way to cook rice?"), (1, 1, "b", "With a lot of water in a pot."),
            (1, 2, "a", "On Monday, b wrote:\n> With a lot of  WATER in a pot.\n>> What is the best way to cook rice?\nThanks for that."),
            (1, 3, "b", "> What is the best way to cook rice?\nAs I said."), (2, 0, "c", "> With a lot of water in a pot.\nFrom elsewhere."),
            (3, 0, "d", None), (None, 1, "e", "> What is the best way to cook rice?"), (3, 1, "d", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv long")
    got = {(r["conv"], r["turn"]): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(rows) and got[1, 2]["text"] == "Thanks for that."
    assert (got[1, 2]["to_conv"], got[1, 2]["to_turn"], got[1, 2]["by_quote"]) == (1, 1, True)
    assert got[1, 3]["to_turn"] == 0 and (got[2, 0]["to_conv"], got[2, 0]["to_turn"]) == (1, 1)
    assert got[3, 1]["to_turn"] == 0 and not got[3, 1]["by_quote"] and got[3, 0]["to_turn"] is None and got[None, 1]["to_conv"] is None
    assert quotes.link_quotes(frame.limit(0)).count() == 0
