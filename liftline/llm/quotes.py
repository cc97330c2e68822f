"""Quotation linking: messages without their quotes, linked to the messages that they quote, in reply order.

A line's quote level is the number of ">" in its prefix. Runs of lines of one level are passages; a line that announces a
quote ("... wrote:") goes with it. Every passage of level 1 or more, and each of its lines, is normalised (case, white
space) and hashed. The own text of every message is hashed the same way, as a whole and line by line. A quoting message
is linked to an earlier message of its conversation with an equal hash, or else to the first message with it in a
conversation of a smaller id; whole passages go before lines, outer levels before inner ones, later originals before
earlier ones. A passage under ``LEAST_CHARS`` characters tells nothing about other conversations, so it is looked for in
its own only. A message without a link answers the turn before it, whatever its number.

So every message answers one that is smaller by conversation and turn, or none: the answers are trees. A conversation falls
into runs: a first or quoting message and those after it that answer the turn before. Root and depth of every run are found
by doubling: in each round a run jumps to where its goal points. A thread is a tree; its order is by depth, then
conversation, then turn, so every message comes after the one that it answers.

Intermediate frames are stored, not checkpointed by `frames.checkpointed`: that drops an execution's shuffles when it ends.
Adaptive execution doesn't wait for stages that it started and then finds needless, as the other side of a join is empty;
their tasks would wait for the dropped shuffles until a time limit, holding cores.

A text that very many messages share gives no pairs: originals are reduced to the turns of one conversation that hold
it, of which a quoting message needs the last one before it, and to the first of all. A conversation or thread with very
many messages isn't gathered: runs and places are counted in pieces of all messages.

Null texts count as empty. Rows with a null conversation or turn are kept, link to nothing and are not linked to.
Of rows that repeat conversation and turn each is kept; they are one message of the thread, with the best of their links. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftline.llm.frames import column, stored

LEAST_CHARS = 12

_PREFIX = re.compile(r"(?:[ \t]{0,3}>)+ ?")
_ANNOUNCES = re.compile(r"(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and rest of each line."""
    out = []
    for line in text.splitlines():
        m = _PREFIX.match(line)
        out.append((m[0].count(">"), line[m.end():]) if m else (0, line))
    return out


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> tuple[int, bool] | None:
    """A hash of the normalised text and whether it is short; none of an empty one."""
    text = normalised(text)
    return (xxhash.xxh64_intdigest(text.encode()) - (1 << 63), len(text) < LEAST_CHARS) if text else None


def parse(text: str) -> tuple[str, list[tuple[int, int, bool]], list[int]]:
    """Own text; (rank, hash, short) of quoted passages and lines, lower ranks first; hashes of own text and lines."""
    lines = levels(text)
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for level, rest in lines:
        if level:
            if not last and own and _ANNOUNCES.search(own[-1].strip()):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(rest)
        else:
            own.append(rest)
        last = level
    quoted: dict[tuple[int, bool], int] = {}
    for level, parts in passages:
        for rank, piece in [(2 * level, "\n".join(parts)), *((2 * level + 1, p) for p in parts)]:
            if (h := digest(piece)) is not None:
                quoted[h] = min(rank, quoted.get(h, rank))
    clean = "\n".join(own).strip() if passages else text
    mine = {h[0] for h in (digest(clean), *map(digest, own)) if h}
    return clean, sorted((r, *h) for h, r in quoted.items()), sorted(mine)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(t.as_py() or "") for t in batch.column(3)]
        quoted = [[{"rank": r, "hash": h, "short": s} for r, h, s in x[1]] for x in rows]
        kind = pa.list_(pa.struct([("rank", pa.int32()), ("hash", pa.int64()), ("short", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([x[0] for x in rows], pa.string()), pa.array(quoted, kind), pa.array([x[2] for x in rows], pa.list_(pa.int64()))],
            names=["conv", "turn", "role", "text", "quoted", "own"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, text (without quotes), n_quoted, to_conv and to_turn (the message it answers),
    by_quote, thread_conv and thread_turn (the root of its thread), depth in the thread, position in its order."""
    rows = messages.select(column(messages, conv_col).alias("conv"), column(messages, turn_col).alias("turn"),
                           column(messages, role_col).cast("string").alias("role"), column(messages, text_col).alias("text"))
    kinds = dict(rows.dtypes)
    parsed = rows.mapInArrow(_parse, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, text string, "
                                     "quoted array<struct<rank: int, hash: long, short: boolean>>, own array<long>")
    valid = "conv is not null and turn is not null"
    links = _links(stored(parsed.filter(valid).select("conv", "turn", "quoted", "own")), kinds["turn"])
    threads = _threads(rows.filter(valid).select("conv", "turn"), links)
    return parsed.select("conv", "turn", "role", "text", F.size("quoted").cast("long").alias("n_quoted")).join(threads, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "text", "n_quoted", "to_conv", "to_turn", F.coalesce("by_quote", F.lit(False)).alias("by_quote"), "thread_conv",
        "thread_turn", "depth", "position")


def _links(known: DataFrame, turn_kind: str) -> DataFrame:
    """conv, turn, to (conv, turn) and its order among the message's links, smallest first: every found quote."""
    quotes = known.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.rank", "q.hash", "q.short")
    wanted = quotes.select("hash").distinct()
    # only what somebody quotes is looked for among the originals
    origins = stored(known.select("conv", "turn", F.explode("own").alias("hash")).join(wanted, "hash", "left_semi").distinct())
    # within a conversation: the last original turn before the quoting one, by one window over both
    both = origins.select("hash", "conv", "turn", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("boolean").alias("short"), F.col("turn").alias("origin")).unionByName(
        quotes.select("hash", "conv", "turn", "rank", "short", F.lit(None).cast(turn_kind).alias("origin")).distinct())
    before = Window.partitionBy("hash", "conv").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("to_turn", F.max("origin").over(before)).filter("rank is not null")
    first = origins.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("first"))
    far = near.join(first, "hash", "left")
    elsewhere = F.col("to_turn").isNull() & ~F.col("short") & (F.col("first.conv") < F.col("conv"))
    found = far.select("conv", "turn", "rank", F.when(elsewhere, F.col("first.conv")).otherwise(F.col("conv")).alias("to_conv"),
                       F.when(elsewhere, F.col("first.turn")).otherwise(F.col("to_turn")).alias("to_turn"), F.coalesce(elsewhere, F.lit(False)).alias("elsewhere"))
    return found.filter("to_turn is not null").select("conv", "turn", F.struct(F.col("to_conv").alias("conv"), F.col("to_turn").alias("turn")).alias("to"),
                                                      F.struct("elsewhere", "rank", -F.col("to_turn"), "to_conv").alias("order"))


def _threads(turns: DataFrame, links: DataFrame) -> DataFrame:
    """turns (conv, turn) with to_conv, to_turn, by_quote, thread_conv, thread_turn, depth, position."""
    dealt = _dealt(turns.unionByName(links, allowMissingColumns=True), ["conv", "turn"])
    messages = stored(dealt.groupBy("conv", "turn", "piece").agg(F.min_by("to", "order").alias("to")))
    quoting, later = F.col("to").isNotNull(), F.col("place") > F.col("opened.place")
    answers = stored(_runs(messages, ["conv"], ["conv", "turn"], quoting).select(
        "conv", "turn", F.when(quoting, F.col("to.conv")).when(later, F.col("conv")).alias("to_conv"),
        F.when(quoting, F.col("to.turn")).when(later, F.col("prior.turn")).alias("to_turn"), quoting.alias("by_quote"),
        F.col("opened.place").alias("run"), F.col("opened.turn").alias("run_turn"), (F.col("place") - F.col("opened.place")).alias("since")))
    # of each run that a quote opens: the run that it points into, how far up that one's first message is, and whether it may point on
    goals = answers.select(F.col("conv").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("run").alias("goal"), F.col("run_turn").alias("goal_turn"), "since")
    ups = stored(answers.filter("by_quote").select("run", "to_conv", "to_turn").join(goals, ["to_conv", "to_turn"]).select(
        "run", "goal", F.col("to_conv").alias("goal_conv"), "goal_turn", (F.col("since") + 1).alias("up"), F.lit(True).alias("moved")))
    while not ups.filter("moved").isEmpty():
        above = ups.select(F.col("run").alias("goal"), F.struct("goal", "goal_conv", "goal_turn", "up").alias("next"))
        on = F.col("next").isNotNull()
        ups = stored(ups.join(above, "goal", "left").select(
            "run", *[F.when(on, F.col(f"next.{c}")).otherwise(F.col(c)).alias(c) for c in ("goal", "goal_conv", "goal_turn")],
            (F.col("up") + F.coalesce("next.up", F.lit(0))).alias("up"), on.alias("moved")))
    rooted = answers.join(ups, "run", "left").select(
        "conv", "turn", "to_conv", "to_turn", "by_quote", F.coalesce("goal_conv", "conv").alias("thread_conv"), F.coalesce("goal_turn", "run_turn").alias("thread_turn"),
        (F.col("since") + F.coalesce("up", F.lit(0))).alias("depth"))
    thread, order = ["thread_conv", "thread_turn"], ["thread_conv", "thread_turn", "depth", "conv", "turn"]
    return _runs(stored(_dealt(rooted, order)), thread, order, F.lit(False)).select(*rooted.columns, (F.col("place") - F.col("opened.place")).alias("position"))


def _dealt(frame: DataFrame, order: list[str]) -> DataFrame:
    """frame in ranges of the order, with `piece`, the number of each row's range."""
    return frame.repartitionByRange(*order).withColumn("piece", F.spark_partition_id())


def _runs(frame: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """frame, dealt and stored, with `place` (from 1, over all rows), `prior` (the row before) and `opened` (place and turn of
    the row that opens its run). A run opens where `opens` holds and where the keys change; keys are the first of order.

    Rows are counted in pieces, whatever their keys; what goes from piece to piece is one row for each piece.
    """
    inside, pieces = Window.partitionBy("piece").orderBy(*order), Window.orderBy("piece")
    row, key = F.struct(*order), F.struct(*keys)
    rows = frame.withColumns({"inner": F.row_number().over(inside).cast("long"), "prior": F.lag(row).over(inside), "_opens": opens | (F.lag(key).over(inside) != key)})
    rows = rows.withColumn("opened", F.max(F.when(F.col("_opens"), F.struct(F.col("inner").alias("place"), "turn"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("piece").agg(F.count("*").alias("n"), F.max("opened").alias("opened"), F.min(row).alias("first"), F.max(row).alias("last"))
    earlier = pieces.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "end": F.lag("last").over(pieces)})
    changed = F.col("end").isNull() | (F.struct(*[f"end.{k}" for k in keys]) != F.struct(*[f"first.{k}" for k in keys]))

    def opened(place: Column, turn: str) -> Column:
        return F.struct((F.col("before") + place).alias("place"), F.col(turn).alias("turn"))

    ends = ends.withColumn("new", F.when(changed, opened(F.lit(1), "first.turn")))
    known = F.coalesce(F.when(F.col("opened").isNotNull(), opened(F.col("opened.place"), "opened.turn")), "new")
    ends = ends.withColumn("known", known).select("piece", "before", "end", F.coalesce("new", F.last("known", ignorenulls=True).over(earlier)).alias("carried"))
    mine = F.when(F.col("opened").isNotNull(), opened(F.col("opened.place"), "opened.turn")).otherwise(F.col("carried"))
    return rows.join(F.broadcast(ends), "piece").select(
        *[c for c in frame.columns if c != "piece"], (F.col("before") + F.col("inner")).alias("place"), F.coalesce("prior", "end").alias("prior"), mine.alias("opened"))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Sorted by thread and position in it: every message after the one that it answers."""
    return linked.orderBy("thread_conv", "thread_turn", "position", "conv", "turn")
