"""Prefix trie of conversations, built as ternary search trees over range shards of turn ids.

Turns (role and text) are dictionary-encoded: equal turns have one number. Conversations become sequences of numbers,
equal sequences become one entry, and entries are dealt in ascending order to range shards of about ``SHARD`` numbers.
A shard inserts its entries into a ternary search tree, the median first, then the medians of both halves and so on,
which balances the trees of siblings. A traversal with a stack of its own lists the nodes, parents first; read backwards
it accumulates members, leaves and savings. Nodes on the paths of a shard's first and last entry are its boundary: only
they can be in other shards too. Their sums without boundary children are merged by path, and each merged node then
adds its part to all its beginnings. All other nodes are done.

A sequence is cut into bands of ``BAND`` turns, so a conversation may be of any length. Going down, a band's entry is
named by its smallest member, which is the root of the next band's entries. Going up, a band's roots hand their sums to
the entries of the band above. With no conversation longer than a band there is just one.

A null turn sorts first; equal turns of a conversation are ordered by role and text, so rows that repeat are turns that
repeat. Null role or text is empty text. Rows with a null conversation id take no part. A conversation without turns
ends at the root. An empty table gives no nodes. Turns are compared by SHA-256 of role and text; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm.frames import checkpointed, column, numbered

BAND, SHARD, PIECE = 512, 1 << 18, 1 << 13
#: Bytes of merged boundary nodes that are broadcast at most.
BROADCAST = 1 << 25
_NODES = ("boundary boolean, path array<long>, least long, depth long, parent long, n long, children long, leaves long, weight long, unit long, "
          "bytes long, ends long, ending long")
_KINDS = {"boundary": pa.bool_(), "path": pa.list_(pa.int64())}


# Turns ------------------------------------------------------------------------------------------------------------


def encoded(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), key and bytes of every turn: key stands for role and text, bytes is the text's size in UTF-8."""
    role, text = (F.coalesce(column(conversations, c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(column(conversations, id_col).cast("long").alias("conv"), column(conversations, turn_col).alias("turn"), key.alias("key"),
                                 F.octet_length(text).cast("long").alias("bytes")).filter("conv is not null")
    # a conversation with very many turns is counted piece by piece
    return numbered(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("key")]).select("conv", "pos", "key", "bytes")


# A shard ----------------------------------------------------------------------------------------------------------


class TernaryTree:
    """Ternary search tree of sequences of numbers; every node is one node of the trie. All sequences have a number or more."""

    def __init__(self) -> None:
        self.symbol, self.low, self.equal, self.high = [], [], [], []
        self.n, self.least, self.bytes, self.end = [], [], [], []

    def _node(self, symbol: int, size: int) -> int:
        for field, value in ((self.symbol, symbol), (self.low, -1), (self.equal, -1), (self.high, -1), (self.n, 0), (self.least, None),
                             (self.bytes, size), (self.end, None)):
            field.append(value)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int], sizes: list[int], n: int, least: int, end: dict) -> None:
        symbol, low, equal, high = self.symbol, self.low, self.equal, self.high
        if not symbol:
            self._node(sequence[0], sizes[0])
        at = 0
        for i, s in enumerate(sequence):
            if i:
                if equal[at] < 0:
                    equal[at] = self._node(s, sizes[i])
                at = equal[at]
            while s != symbol[at]:
                side = low if s < symbol[at] else high
                if side[at] < 0:
                    side[at] = self._node(s, sizes[i])
                at = side[at]
            self.n[at] += n
            self.least[at] = least if self.least[at] is None else min(self.least[at], least)
        self.end[at] = end

    def path(self, sequence: list[int]) -> list[int]:
        """The nodes of an inserted sequence."""
        out, at = [], 0
        for i, s in enumerate(sequence):
            at = self.equal[at] if i else at
            while s != self.symbol[at]:
                at = self.low[at] if s < self.symbol[at] else self.high[at]
            out.append(at)
        return out

    def listed(self) -> list[tuple[int, int, int]]:
        """(node, parent or -1, depth), parents first."""
        out, stack = [], [(0, -1, 0)] if self.symbol else []
        while stack:
            at, parent, depth = stack.pop()
            out.append((at, parent, depth))
            stack += [(side[at], parent, depth) for side in (self.low, self.high) if side[at] >= 0]
            if self.equal[at] >= 0:
                stack.append((self.equal[at], at, depth + 1))
        return out


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1: the middle, then the middles of both halves, and so on."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


def shard_nodes(entries: list[dict], named_roots: bool) -> Iterator[dict]:
    """The nodes of a shard's entries, which ascend by root and ids."""
    tree = TernaryTree()
    for i in medians_first(len(entries)):
        e = entries[i]
        tree.insert([e["root"], *e["ids"]], [0, *e["sizes"]], e["n"], e["least"], e)
    edges = {at: [e["root"], *e["ids"]][:i + 1] for e in (entries[0], entries[-1]) for i, at in enumerate(tree.path([e["root"], *e["ids"]]))}
    listed, size = tree.listed(), len(tree.symbol)
    children, leaves, weight, unit = ([0] * size for _ in range(4))
    for at, parent, _ in reversed(listed):
        end = tree.end[at]
        if end is not None and end["below"] is not None:  # what the next band found under this node
            below = end["below"]
            children[at] += below["children"]
            leaves[at] += below["leaves"]
            weight[at] += below["weight"]
            unit[at] += below["unit"]
        if at not in edges:
            leaves[at] += children[at] == 0
            weight[at] += tree.n[at] * tree.bytes[at]
            unit[at] += tree.bytes[at]
            if parent >= 0:
                children[parent] += 1
                leaves[parent] += leaves[at]
                weight[parent] += weight[at]
                unit[parent] += unit[at]
    for at, parent, depth in listed:
        end = tree.end[at] or {"ends": 0, "ending": None}
        at_edge = at in edges
        up = -1 if at_edge else parent
        yield {"boundary": at_edge, "path": edges[at] if at_edge else edges.get(up), "depth": depth,
               "least": tree.symbol[at] if named_roots and depth == 0 else tree.least[at],
               "parent": None if up < 0 or up in edges else tree.symbol[up] if named_roots and depth == 1 else tree.least[up],
               "n": tree.n[at], "children": children[at], "leaves": leaves[at], "weight": weight[at], "unit": unit[at], "bytes": tree.bytes[at],
               "ends": end["ends"], "ending": end["ending"]}


def _batches(rows: Iterator[dict], size: int = 8192) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _NODES.split(", ")]
    schema = pa.schema([(n, _KINDS.get(n, pa.int64())) for n in names])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


# Bands ------------------------------------------------------------------------------------------------------------


def _band_nodes(entries: DataFrame, named_roots: bool, shard: int) -> DataFrame:
    """All nodes of a band, merged: least, depth in the band, parent, n, children, leaves, weight, unit, ending, root."""
    numbers = entries.agg(F.sum(F.size("ids") + 1)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            yield from _batches(shard_nodes(rows, named_roots))

    shards = entries.repartitionByRange(max(1, -(-numbers // shard)), "root", "ids").sortWithinPartitions("root", "ids")
    nodes = checkpointed(shards.mapInArrow(run, _NODES))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "weight", "unit", "ends")]
    edge = checkpointed(nodes.filter("boundary").groupBy("path").agg(
        *sums, F.min("least").alias("least"), F.max("bytes").alias("bytes"), F.min("ending").alias("ending")))
    above = F.slice("path", 1, F.size("path") - 1)
    kids = edge.groupBy(above.alias("path")).agg(F.count("*").alias("kids"))
    edge = edge.join(kids, "path", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    edge = checkpointed(edge.select("path", "least", "n", "children", "ending", (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("leaves"),
                                    (F.col("weight") + F.col("n") * F.col("bytes")).alias("weight"), (F.col("unit") + F.col("bytes")).alias("unit")))
    beginnings = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i)))
    totals = edge.select(beginnings.alias("path"), "leaves", "weight", "unit").groupBy("path").agg(*(F.sum(c).alias(c) for c in ("leaves", "weight", "unit")))
    edge = checkpointed(edge.drop("leaves", "weight", "unit").join(totals, "path"))

    spread = edge.agg(F.sum(8 * F.size("path") + 16)).first()[0] or 0
    parents = edge.select(F.col("path").alias("upper"), F.col("least").alias("up"))
    parents = F.broadcast(parents) if spread <= BROADCAST else parents
    columns = ["least", "depth", "n", "children", "leaves", "weight", "unit", "ending"]
    inner = nodes.filter("not boundary").join(parents, F.col("path") == F.col("upper"), "left").select(
        *columns, F.coalesce("parent", "up").alias("parent"))
    edge = edge.withColumn("depth", F.size("path").cast("long") - 1)
    return inner.unionByName(edge.join(parents, above == F.col("upper"), "left").select(*columns, F.col("up").alias("parent")))


def digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """ending, sha of conversations (ending, conv): SHA-256 of the ids of each ending, ascending and joined by commas.
    Ids are joined piece by piece in range partitions; a piece after the other goes through the hash."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for ending, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ending != now or len(held) >= piece:
                    if held:
                        out.append((now, first, ",".join(held)))
                    now, first, held = ending, conv, []
                held.append(str(conv))
            yield made(out)
            out = []
        if held:
            yield made([(now, first, ",".join(held))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], names=["ending", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for ending, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if ending != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = ending, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield done(out)
        if sha is not None:
            yield done([(now, sha.hexdigest())])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["ending", "sha"])

    joined = checkpointed(ends.select("ending", "conv").repartitionByRange("ending", "conv").sortWithinPartitions("ending", "conv").mapInArrow(
        pieces, "ending long, first long, ids string"))
    return joined.repartition("ending").sortWithinPartitions("ending", "first").mapInArrow(hashes, "ending long, sha string")


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND, shard: int = SHARD) -> DataFrame:
    """The nodes of turns (conv, pos from 0, key, bytes) of conversations (conv, one row each, also those without turns):
    conv (smallest member), depth, parent_conv, n_convs, n_children, n_leaves, saved, ends_sha."""
    dictionary = checkpointed(turns.groupBy("key").agg(F.max("bytes").alias("bytes")).withColumn("id", F.monotonically_increasing_id()))
    rows = turns.select("conv", "pos", "key").join(dictionary, "key").withColumn("band", F.floor(F.col("pos") / band))
    parts = rows.groupBy("conv", "band").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "bytes"))).alias("s"))  # at most band turns
    parts = checkpointed(parts.select("conv", "band", F.col("s.id").alias("ids"), F.col("s.bytes").alias("sizes")))
    last = parts.groupBy("conv").agg(F.max("band").alias("last"))
    convs = checkpointed(convs.select("conv").join(last, "conv", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("long"))))
    bands = (convs.agg(F.max("last")).first()[0] or 0) + 1

    named, entries, ends = convs.withColumn("root", F.lit(0).cast("long")), [], []
    none = F.array().cast("array<long>")
    for b in range(bands):
        part = named.join(parts.filter(F.col("band") == b).drop("band"), "conv", "left").select(
            "conv", "last", "root", F.coalesce("ids", none).alias("ids"), F.coalesce("sizes", none).alias("sizes"))
        part = checkpointed(part) if bands > 1 else part
        ending = F.col("last") == b
        entries.append(checkpointed(part.groupBy("root", "ids").agg(
            F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("least"), F.count_if(ending).alias("ends"),
            F.min(F.when(ending, F.col("conv"))).alias("ending"))))
        met = checkpointed(part.select("conv", "last", "root", "ids").join(entries[b].select("root", "ids", "least", "ending"), ["root", "ids"]))
        ends.append(met.filter(ending).select("ending", "conv"))
        named = met.filter(~ending).select("conv", "last", F.col("least").alias("root"))

    below, out = None, []
    for b in reversed(range(bands)):
        if below is None:
            full = entries[b].withColumn("below", F.lit(None).cast("struct<children:long,leaves:long,weight:long,unit:long>"))
        else:
            full = entries[b].join(below, (F.col("least") == F.col("named")) & (F.size("ids") == band), "left").drop("named")
        nodes = checkpointed(_band_nodes(full, b > 0, shard))
        if b:
            below = nodes.filter("depth = 0").select(F.col("least").alias("named"), F.struct("children", "leaves", "weight", "unit").alias("below"))
            nodes = nodes.filter("depth > 0")
        out.append(nodes.withColumn("depth", F.col("depth") + b * band))
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    for other in ends[1:]:
        ends[0] = ends[0].unionByName(other)
    # nodes at which none ends are no rows of the join
    ended = out[0].filter("ending is not null").join(digests(ends[0]), "ending")
    return ended.unionByName(out[0].filter("ending is null").withColumn("sha", F.sha2(F.lit(""), 256))).select(
        F.col("least").alias("conv"), "depth", F.col("parent").alias("parent_conv"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("weight") - F.col("unit")).alias("saved"), F.col("sha").alias("ends_sha"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      **how) -> DataFrame:
    """The prefix trie of the conversations as they are."""
    turns = checkpointed(encoded(conversations, id_col, turn_col, role_col, text_col))
    return trie(turns, turns.select("conv").distinct(), **how)
