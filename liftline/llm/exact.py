"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text, A-Z in lower case, is cut into blocks of a fixed number of characters. Distinct blocks are sorted and
numbered: that number is the block's name. Names of neighbours are then paired and each distinct pair gets a name in
the same way, level by level, until a document has one name. Two documents have the same level and name exactly if
their texts are equal: names stand for compared values, not for hashes.

The blocks that occur most often are named through a broadcast of at most ``HOT_BLOCKS`` rows, so that copies of one
text don't meet in one task; any other block has less than a thousandth of all rows. Later levels hold integers only;
there both sides of the join are plain shuffles, which adaptive execution splits.

Null texts count as empty. A null doc_id is a key like any other and sorts below all others. Rows that repeat a doc_id
and text are told apart by a running copy number, of which 1 may stay. An empty table gives an empty result. Other
columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.frames import ascii_lower, checkpointed, column, free_name

BLOCK_CHARS = 8192
HOT_BLOCKS = 1000


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(text, F.octet_length(text))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("doc"), row_key(text).alias("row"), ascii_lower(text).alias("norm"))
    count = F.greatest(F.lit(1), F.ceil(F.char_length("norm") / block_chars).cast("int"))
    rows = rows.select("doc", "row", count.alias("n"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars))).alias("parts"))
    # outer: the optimizer would else test every array for emptiness first, and so make all blocks twice
    rows = rows.select("doc", "row", "n", "sha", F.posexplode_outer("parts").alias("i", "block"))
    return rows.withColumn("sha", F.when(F.col("i") == 0, F.col("sha")))


def _name_blocks(blocks: DataFrame, hot_blocks: int) -> DataFrame:
    """Each block's row with its block's name instead of the block."""
    blocks = blocks.withColumn("h", F.xxhash64("block"))
    hot = checkpointed(blocks.groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(hot_blocks)
                       .select("h", F.lit(True).alias("hot")))
    blocks = blocks.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("h")
    # few rows: at most as many as hot has, but for equal hashes
    often = blocks.filter("hot").select("block").distinct().select(
        "block", (F.row_number().over(Window.orderBy("block")).cast("long") * 2 + 1).alias("often"))
    # block first: it is both the sort key and the key of the shuffle that the join needs
    rare = blocks.filter("not hot").select("block").distinct().sortWithinPartitions("block").select(
        F.col("block").alias("key"), (F.monotonically_increasing_id() * 2).alias("rare"), F.lit(0).alias("side"))
    named = blocks.join(F.broadcast(checkpointed(often)), "block", "left")
    # a row that has its name already takes a key of its own, so that these rows spread over the tasks
    named = named.select("doc", "row", "n", "sha", "i", "often",
                         F.when(F.col("hot"), F.hex("row")).otherwise(F.col("block")).alias("key"),
                         F.col("hot").cast("int").alias("side"))
    return named.join(rare, ["key", "side"], "left").select(
        "doc", "row", "n", "sha", "i", F.coalesce("often", "rare").alias("name"), F.lit(1).cast("long").alias("copies"))


def _pair_up(rows: DataFrame) -> DataFrame:
    """One level up: the names of pairs of neighbours. An odd last name pairs with none."""
    even = F.col("i") % 2 == 0
    pairs = checkpointed(rows.groupBy("doc", "row", "n", F.expr("i div 2").cast("int").alias("at")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        F.max("sha").alias("sha"), F.sum(F.when(even, F.col("copies"))).alias("copies")))
    names = checkpointed(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn(
        "name", F.monotonically_increasing_id()))
    return checkpointed(pairs.join(names, ["left", "right"]).select(
        "doc", "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "sha", F.col("at").alias("i"), "name", "copies"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
               hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """doc, row (tells repeated doc_ids apart), sha (SHA-256 of the normalised text), copies, level, name."""
    rows = checkpointed(_name_blocks(_blocks(docs, id_col, text_col, block_chars), hot_blocks))
    done, level = None, 0
    while True:
        ended = rows.filter("n = 1").select("doc", "row", "sha", "copies", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter("n > 1")
        if rows.isEmpty():
            break
        rows, level = _pair_up(rows), level + 1
    return done.groupBy("doc", "row", "level", "name").agg(F.sum("copies").alias("copies"), F.max("sha").alias("sha"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
               hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per document: doc, row, copy, keep (the doc that stays), size (of its group), kept, sha."""
    names = checkpointed(identities(docs, id_col, text_col, block_chars, hot_blocks))
    groups = checkpointed(names.groupBy("level", "name").agg(
        F.max(F.struct("doc", "row")).alias("best"), F.sum("copies").alias("size")))
    rows = names.join(groups, ["level", "name"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("row") == F.col("best.row")) & (F.col("copy") == 1)
    return rows.select("doc", "row", "copy", F.col("best.doc").alias("keep"), "size", kept.alias("kept"), "sha")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest doc_id."""
    keep = duplicates(docs, id_col, text_col, block_chars).filter("kept").select(
        F.col("doc").alias("k_doc"), F.col("row").alias("k_row"))
    keep = checkpointed(keep)
    everything, row = free_name(docs, "all_columns"), free_name(docs, "row")
    packed = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias(everything), column(docs, id_col).alias("k_doc"),
                         row_key(F.coalesce(column(docs, text_col), F.lit(""))).alias(row))
    joined = packed.alias("d").join(keep.alias("k"), (F.col(f"d.{row}") == F.col("k.k_row")) & F.col("d.k_doc").eqNullSafe(F.col("k.k_doc")), "left_semi")
    # of rows that repeat id and text any may stay; maps have no hash, so they don't bear on which
    hashed = [F.col(everything)[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(row, "k_doc").orderBy(F.xxhash64(*hashed))
    return joined.withColumn("turn", F.row_number().over(first)).filter("turn = 1").select(f"{everything}.*")
