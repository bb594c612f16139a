"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role and text); its members are
the conversations that start with it. Totals run from the leaves to the root.
Time-forward processing takes the nodes in reverse level order (deepest first)
and sends each node's totals to its parent as a message that waits in a priority
queue until the order reaches the parent; the queue spills to disk in sorted
runs, so memory does not follow the size of a trie.

Shards are subtrees of at most ``members`` conversations whose parent has more.
They are sorted (by Spark's external sort) and processed side by side; the
totals of shard roots are added up by parent and go into a last round over the
nodes above. There are fewer of those than rows / ``members``: each holds more
than ``members`` of the rows, so with the bound growing as rows / 100,000 there
are fewer than 100,000, whatever the conversations look like.

A node's name is its depth and the exclusive or of two independent 64-bit
hashes of (position, turn digest) over its turns, so a turn's own share undone
gives the parent's name, and prefixes of one long conversation are computed in
blocks of positions. Turns are known by SHA-256 digests; texts are not shuffled.

Cases: null role or text is empty; null turns come first; turns that tie are
ordered by digest, and repeated rows are repeated turns. Rows without ``conv_id``
belong to no conversation and are left out. Texts of any length become one
digest and a number of words. An empty table has no trie, so no rows. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.llm.common import folder, remove, ship, written
from reefline.operators.ranking import bucketed_index

ship(__name__)

POSITIONS = 4096  # positions of a conversation that are ranked and hashed together
MEMBERS = 256
TOP_NODES = 100_000
QUEUED = 200_000  # messages in memory
NODE = ["depth", "n1", "n2"]
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words, place`` per row; ``place`` counts a conversation's turns from 0."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    block = F.coalesce(F.floor(F.col("turn") / POSITIONS), F.lit(-(1 << 62)))
    return bucketed_index(own, ["conv_id"], block, [F.col("turn").asc_nulls_first(), F.col("digest")], "place")


def shared_heads(rows: DataFrame, span: int, most: int) -> DataFrame:
    """Rebuilt conversations: each takes its first turns from the first conversation of its ``span``.

    Conversation c takes h = crc32(c) % (most + 1) turns from c - c % span and
    goes on with its own turns after its first h. Returns ``conv_id, place,
    digest, words`` and one row per conversation with null ``place``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % span
    ids = rows.select("conv_id").distinct()
    heads = rows.filter((F.col("place") < most) & (F.col("conv_id") % span == 0))
    # at most `most` turns, so each conversation's head is one small row
    head = heads.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head")
    )
    whole = ids.select("conv_id", h.alias("h"), base.alias("base")).join(head, "base", "left")
    whole = whole.select("conv_id", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")).alias("head"))
    front = whole.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.place").cast("bigint").alias("place"), "t.digest", "t.words"
    )
    tail = (
        rows.join(whole.select("conv_id", "h", F.size("head").alias("k")), "conv_id")
        .filter(F.col("place") >= F.col("h"))
        .select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "words")
    )
    bare = ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("place", "bigint"), ("digest", "binary"), ("words", "bigint"))])
    return front.unionByName(tail).unionByName(bare)


def plain(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``shared_heads``."""
    ids = rows.select("conv_id").distinct()
    bare = ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("place", "bigint"), ("digest", "binary"), ("words", "bigint"))])
    return rows.select("conv_id", "place", "digest", "words").unionByName(bare)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, n1, n2, own1, own2, words, last`` per conversation and depth; depth 0 is the root."""
    block = F.floor(F.col("place") / POSITIONS)
    own = rebuilt.select(
        "conv_id",
        F.coalesce("place", F.lit(-1)).alias("place"),
        F.coalesce(block, F.lit(0)).alias("block"),
        F.when(F.col("place").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("one"), "place", "digest")).cast("bigint").alias("own1"),
        F.when(F.col("place").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("two"), "digest", "place")).cast("bigint").alias("own2"),
        F.coalesce("words", F.lit(0)).cast("bigint").alias("words"),
    )
    # what lies in earlier blocks; only conversations of several blocks have any
    whole = own.groupBy("conv_id", "block").agg(
        F.bit_xor("own1").alias("w1"), F.bit_xor("own2").alias("w2"), F.max("place").alias("top")
    )
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("w1").over(by_block), F.lit(0)).alias("w1"),
        F.coalesce(F.bit_xor("w2").over(by_block), F.lit(0)).alias("w2"),
        F.max("top").over(Window.partitionBy("conv_id")).alias("top"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = own.withColumns({"i1": F.bit_xor("own1").over(upto), "i2": F.bit_xor("own2").over(upto)})
    return inside.join(starts, ["conv_id", "block"]).select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        F.col("i1").bitwiseXOR(F.col("w1")).alias("n1"),
        F.col("i2").bitwiseXOR(F.col("w2")).alias("n2"),
        "own1",
        "own2",
        "words",
        (F.col("place") == F.col("top")).alias("last"),
    )


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row per node: smallest member, members, words of the last turn and the parent's name."""
    return (
        paths.groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("words").alias("words"),
            F.max("own1").alias("own1"),
            F.max("own2").alias("own2"),
        )
        .select(
            *NODE,
            "conv_id",
            "n_convs",
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
            F.col("n1").bitwiseXOR(F.col("own1")).alias("p1"),
            F.col("n2").bitwiseXOR(F.col("own2")).alias("p2"),
        )
    )


class SpillingQueue:
    """A priority queue of tuples; what exceeds ``held`` entries waits in sorted runs on disk."""

    def __init__(self, held: int = QUEUED):
        self.held, self.heap, self.runs, self.files = held, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        """Write the later half as a run; the earlier half is wanted soon."""
        self.heap.sort()
        half = len(self.heap) // 2
        file = tempfile.TemporaryFile()
        for i in range(half, len(self.heap), 1024):
            pickle.dump(self.heap[i : min(i + 1024, len(self.heap))], file)
        del self.heap[half:]
        file.seek(0)
        self.files.append(file)
        self._next(self._items(file))

    @staticmethod
    def _items(file) -> Iterator[tuple]:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                file.close()
                return

    def _next(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, id(run), run))

    def first(self) -> tuple | None:
        """The least entry."""
        tops = [q[0] for q in (self.heap,) if q] + [q[0][0] for q in (self.runs,) if q]
        return min(tops, default=None)

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, _, run = heapq.heappop(self.runs)
        self._next(run)
        return item

    def close(self) -> None:
        for file in self.files:
            file.close()


def time_forward(rows: Iterator[tuple], held: int = QUEUED) -> Iterator[tuple]:
    """Subtree totals of nodes in reverse level order.

    ``rows`` are ``s1, s2, depth, n1, n2, p1, p2, saved, children, leaves`` by
    shard (s1, s2), falling depth and name; ``saved``, ``children`` and ``leaves``
    already hold what comes from other shards. Gives ``s1, s2, depth, n1, n2, p1,
    p2, n_children, n_leaves, saved_tokens``.
    """
    queue = SpillingQueue(held)
    try:
        for s1, s2, depth, n1, n2, p1, p2, saved, children, leaves in rows:
            key = (s1, s2, -depth, n1, n2)
            while (first := queue.first()) is not None and first[:5] <= key:
                message = queue.pop()
                if message[:5] == key:  # else the parent lies in another shard
                    children += 1
                    leaves += message[5]
                    saved += message[6]
            leaves = leaves or 1
            queue.push((s1, s2, 1 - depth, p1, p2, leaves, saved))
            yield s1, s2, depth, n1, n2, p1, p2, children, leaves, saved
    finally:
        queue.close()


IN = ["s1", "s2", "depth", "n1", "n2", "p1", "p2", "saved", "children", "leaves"]
OUT = ["s1", "s2", "depth", "n1", "n2", "p1", "p2", "n_children", "n_leaves", "saved_tokens"]
OUT_ARROW = pa.schema([(c, pa.int64()) for c in OUT])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    found: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], schema=OUT_ARROW)

    for row in time_forward(rows):
        found.append(row)
        if len(found) == 8192:
            yield batch()
            found = []
    if found:
        yield batch()


def _processed(nodes: DataFrame) -> DataFrame:
    """Time-forward processing of each shard (s1, s2)."""
    ordered = nodes.select(*IN).sortWithinPartitions("s1", "s2", F.desc("depth"), "n1", "n2")
    return ordered.mapInArrow(_forward, ", ".join(f"{c} bigint" for c in OUT))


def subtree_totals(nodes: DataFrame, paths: DataFrame, members: int, where: str) -> DataFrame:
    """``depth, n1, n2, n_children, n_leaves, saved_tokens, parent_conv_id`` per node.

    ``nodes`` and ``paths`` are written tables; ``members`` bounds the conversations of a shard.
    """
    is_top = (F.col("n_convs") > members) | (F.col("depth") == 0)
    # fewer than TOP_NODES rows, as the bound grows with the rows
    top = written(nodes.filter(is_top), f"{where}/top")
    marks = F.broadcast(top.select(*NODE, F.lit(True).alias("top")))
    above = F.broadcast(
        top.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("top_conv_id"))
    )
    # the topmost node of few members on each conversation's way is its shard
    shard = (
        paths.withColumns({"p1": F.col("n1").bitwiseXOR(F.col("own1")), "p2": F.col("n2").bitwiseXOR(F.col("own2"))})
        .join(above, ["depth", "p1", "p2"], "left_semi")
        .join(marks, NODE, "left_anti")
        .select("conv_id", F.col("n1").alias("s1"), F.col("n2").alias("s2"))
    )
    low = nodes.filter(~is_top)
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = low.join(shard, "conv_id").withColumns({"children": F.lit(0).cast("bigint"), "leaves": F.lit(0).cast("bigint")})
    lower = written(_processed(own.repartition(parts, "s1", "s2")), f"{where}/low")
    sent = (
        lower.filter((F.col("n1") == F.col("s1")) & (F.col("n2") == F.col("s2")))
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("more"))
    )
    upper = top.join(sent, NODE, "left").select(
        F.lit(0).cast("bigint").alias("s1"),
        F.lit(0).cast("bigint").alias("s2"),
        *NODE,
        "p1",
        "p2",
        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
        F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
    )
    totals = lower.unionByName(_processed(upper.coalesce(1)))
    # a parent of few members has few children, so no name is hot in the second join
    parents = low.select(
        (F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("low_conv_id")
    )
    return (
        totals.join(above, ["depth", "p1", "p2"], "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(*NODE, "n_children", "n_leaves", "saved_tokens", F.coalesce("top_conv_id", "low_conv_id").alias("parent_conv_id"))
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node over its pieces, which come one after another."""
    schema = pa.schema([("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
    now, digest, found = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in zip(*found)], schema=schema)

    for b in batches:
        for depth, n1, n2, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")]):
            if (depth, n1, n2) == now:
                digest.update(b"," + ids.encode())
                continue
            if now:
                found.append((*now, digest.hexdigest()))
                if len(found) == 8192:
                    yield batch()
                    found = []
            now, digest = (depth, n1, n2), hashlib.sha256(ids.encode())
    if now:
        found.append((*now, digest.hexdigest()))
        yield batch()


def end_digests(paths: DataFrame) -> DataFrame:
    """``depth, n1, n2, ends_sha256`` of nodes where conversations end."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.floor(F.col("conv_id") / POSITIONS).alias("span")  # at most POSITIONS ids
    pieces = paths.filter("last").groupBy(*NODE, span).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "span").select(*NODE, "ids")
    return ordered.mapInArrow(_digests, "depth bigint, n1 bigint, n2 bigint, ends_sha256 string")


def trie(rebuilt: DataFrame, members: int = MEMBERS) -> DataFrame:
    """The nodes of conversations in the form of ``plain`` or ``shared_heads``, with their subtree totals.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; a node is its smallest member and its depth.
    """
    spark = rebuilt.sparkSession
    where = folder(spark, "trie")
    whole = written(rebuilt, f"{where}/rebuilt")
    paths = written(prefixes(whole), f"{where}/paths")
    remove(spark, f"{where}/rebuilt")
    nodes = written(nodes_of(paths), f"{where}/nodes")
    bound = max(members, paths.count() // TOP_NODES)
    totals = subtree_totals(nodes, paths, bound, where)
    return (
        nodes.select(*NODE, "conv_id", "n_convs")
        .join(totals, NODE)
        .join(end_digests(paths), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, span: int | None = None, most: int = 0, members: int = MEMBERS) -> DataFrame:
    """``trie`` of a table of turns; with ``span``, conversations share heads first (see ``shared_heads``)."""
    spark = conversations.sparkSession
    where = folder(spark, "turns")
    rows = written(turns(conversations), where)
    return trie(shared_heads(rows, span, most) if span else plain(rows), members)
