"""The registered queries of the operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftline.llm import decontaminate, exact, html_blocks, licenses, nearest, packing, periodic, pii, quotes, simhash, substrings, toxicity, trie
from liftline.llm.frames import checkpointed, table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.number("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select(F.col("conv").alias("conv_id"), "turn", "role", F.sha2("text", 256).alias("text_sha256"), "n_quoted", "to_conv", "to_turn",
                         "by_quote", "thread_conv", F.col("thread_turn").cast("long").alias("thread_turn"), "depth", "position")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, machine, F.col("doc_id"))
    return scored.select(F.col("key").alias("doc_id"), toxicity.held_out(F.col("key")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("cut_from", "cut_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return cut.select(F.col("doc").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_pieces(table(spark, sf_dir, "documents"))
    return packed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_blocks.main_text(table(spark, sf_dir, "pages"))
    return text.select(F.col("page").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), simhash.print_hex(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "license", F.round("coverage", 6).alias("coverage"), "start", "end")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
                       F.lower(F.hex("sha")).alias("text_sha256"))


def _replanted(docs: DataFrame) -> DataFrame:
    """documents with the words that operator 11's contract puts in place: in a tenth of them they repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # columns of their own, so that no word makes them anew
    rows = docs.select("doc_id", "text", words.alias("words")).withColumns({"n": F.size("words").cast("long"), "g": F.floor(h / 10)})
    rows = rows.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_replanted(table(spark, sf_dir, "documents")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]).cast("array<string>"), ","), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("doc").alias("doc_id"), "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = checkpointed(trie.encoded(table(spark, sf_dir, "conversations")))
    conv = F.col("conv")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns(
        {"h": F.crc32(conv.cast("string").cast("binary")) % 9, "base": conv - conv % 5})
    convs = checkpointed(convs.join(convs.select(conv.alias("base"), F.col("n").alias("n_base")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("begun")))
    begun = turns.filter("pos < 8").withColumnRenamed("conv", "base").join(convs, "base").filter("pos < h").select("conv", "pos", "key", "bytes")
    own = turns.join(convs, "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("begun")).alias("pos"), "key", "bytes")
    nodes = trie.trie(checkpointed(begun.unionByName(own)), convs)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.col("ends_sha").alias("ends_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_personal_data, op2_quotation_links, op3_toxicity, op4_substring_dedup, op5_best_fit_packing, op6_html_main_text, op7_simhash_classes,
    op8_license_spans, op9_decontamination, op10_exact_dedup, op11_periodic_runs,
    op12_exact_top_k, op13_conversation_trie)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words, with a window's words joined by one space: no word holds a space.
_SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM starts),
firsts AS (SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase),
hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN firsts USING (phrase) WHERE least < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(js, k)), lambda k: words[k]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""

_WORDS = r"list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
sized AS (SELECT item_id, words, least(13, len(words)) AS size FROM b WHERE len(words) > 0),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
windows AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM sized) ON len(words) >= size)),
found AS (SELECT doc_id, item_id, size, i FROM windows JOIN phrases USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) AS n FROM v),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM one q JOIN one c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20"""

# CRC-32 bit by bit; paths are lists of turn digests.
_TRIE = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
  sha256(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
sized AS (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
hashed AS (SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 9 AS h FROM sized),
convs AS (SELECT a.c, a.h, a.base, least(a.h, coalesce(o.n, 0)) AS begun FROM hashed a LEFT JOIN hashed o ON o.c = a.base),
rebuilt AS (SELECT convs.c, t.pos, t.k, t.b FROM convs JOIN t ON t.c = convs.base AND t.pos < convs.h
  UNION ALL SELECT convs.c, t.pos - convs.h + convs.begun, t.k, t.b FROM convs JOIN t ON t.c = convs.c AND t.pos >= convs.h),
whole AS (SELECT c, list(k ORDER BY pos) AS ks, list(b ORDER BY pos) AS bs FROM rebuilt GROUP BY c),
member AS (SELECT convs.c, ks, bs, coalesce(len(ks), 0) AS size, unnest(range(coalesce(len(ks), 0) + 1)) AS d FROM convs LEFT JOIN whole ON whole.c = convs.c),
node AS (SELECT d, CASE WHEN d = 0 THEN [] ELSE ks[1:d] END AS path, min(c) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE max(bs[d]) END AS b,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), '') AS names FROM member GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE path[1:d - 1] END AS path, count(*) AS m FROM node WHERE d > 0 GROUP BY 1, 2),
known AS (SELECT node.*, coalesce(m, 0) AS m FROM node LEFT JOIN kids ON kids.d = node.d AND kids.path = node.path),
up AS (SELECT path, n, b, m, unnest(range(d + 1)) AS a FROM known),
sums AS (SELECT a AS d, CASE WHEN a = 0 THEN [] ELSE path[1:a] END AS path, sum((n - 1) * b) AS saved, count(*) FILTER (WHERE m = 0) AS leaves FROM up GROUP BY 1, 2)
SELECT known.conv_id, known.d AS depth, p.conv_id AS parent_conv_id, known.n AS n_convs, known.m AS n_children, sums.leaves AS n_leaves,
  CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(known.names) AS ends_sha256
FROM known JOIN sums ON sums.d = known.d AND sums.path = known.path
LEFT JOIN node p ON p.d = known.d - 1 AND p.path = CASE WHEN known.d = 1 THEN [] ELSE known.path[1:known.d - 1] END"""

ORACLE = {
    "op13_conversation_trie": _TRIE,
    "op12_exact_top_k": _TOP,
    "op4_substring_dedup": _SUBSTRINGS,
    "op9_decontamination": _CONTAMINATION,
    "op10_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)""",
}
