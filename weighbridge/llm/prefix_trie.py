"""Prefix trie of rebuilt conversations, with subtree totals by time-forward processing.

Conversation ``c`` is rebuilt from the first ``h`` turns of conversation ``c - c % 20`` (all if fewer, none if absent) and
its own turns after its first ``h``, ``h`` being the CRC-32 of its decimal id modulo 4. A node is a distinct sequence
of first turns (role, text); its key is its depth and the XOR of a 128-bit hash of each turn at its place. The smallest
member names a node: ``(conv_id, depth)``; along a conversation's path the nodes it names are a run down to its last turn.

Subtree totals go from the deepest nodes up. A node's members' turns from it on bound its subtree; nodes above
a bound that grows with the square root of all turns (so that shards and what is above them grow alike) and the root are
the top, and each highest node below is the root of a shard. A task takes whole shards, sorts their nodes by reverse level order
(Spark's external sort), and passes totals to parents through a priority queue that spills: when a node's turn
comes, its children's messages are the smallest in the queue. Shard roots then report to the top, whose nodes, joined into
the runs that one conversation names, go through the same queue as one row per run; the nodes inside a run get their
totals as suffix sums in slices. So neither a first turn that a third of all conversations share, nor a conversation
that holds a third of all turns, nor thousands of copies gather in a task: members are counted by partial aggregates,
parents found by :func:`common.lookup`, ranks taken in range-partitioned slices. Texts are read once and not
shuffled. The ids that end at a node are hashed in order by one task as SHA-256 asks, from rows of 2,048 packed ids.

Defined cases: rows without a conversation id belong to none and are left out; null roles and texts are empty;
turns of equal number, null first, are ordered by the 128-bit hash of role and text, and equal rows are turns
each; an empty table has no nodes, not even a root; a conversation without turns after rebuilding ends at the root; very long
texts are hashed and counted whole; other columns are ignored, whatever their names. A queue's spill
file is scratch of its task, unnamed and gone with it, like Spark's own: a repeated task starts anew.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge.llm.common import lookup
from weighbridge.llm.katz import pack, unpack
from weighbridge.plans.ranking import rank_within
from weighbridge.session import materialize

BASE, HEADS = 20, 4  # conversations of a base; h is below HEADS
SLICE = 1 << 16  # places of a run that one window holds
SHARD = 16  # times the square root of all turns: the bound of a shard's nodes
QUEUE = 1 << 18  # messages that a queue holds in memory
ENDS = 2048  # ids in a packed row


# ---- conversations ------------------------------------------------------------------
def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, a, b, words, uid``: a 128-bit hash of role and text, and the text's words."""

    def run(batches):
        for batch in batches:
            digests, words = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                digests.append(hashlib.blake2b(b"%d:%s%s" % (len(role), role, text), digest_size=16).digest())
                words.append(len(text.split()))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(words, pa.int64())],
                names=["conv", "turn", "a", "b", "words"],
            )

    bytes_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), bytes_of(role_col), bytes_of(text_col))
    read = rows.where(F.col("conv").isNotNull()).mapInArrow(run, "conv long, turn long, a long, b long, words long")
    return read.withColumn("uid", F.monotonically_increasing_id())


def running(rows: DataFrame, key: str, order: Column, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with each of ``sums`` (aggregates that merge: ``bit_xor``, ``sum``) over the key's rows up to their own in ``order``,
    whole numbers of which a key has each once: a key is cut in slices of ``SLICE`` places."""
    cut = rows.withColumn("_o", order).withColumn("_slice", F.floor(F.col("_o") / SLICE))
    inside = W.partitionBy(key, "_slice").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = cut.groupBy(key, "_slice").agg(*[agg(F.col(c)).alias(f"_s_{out}") for out, (agg, c) in sums.items()])
    slices = slices.select(key, "_slice", *[agg(F.col(f"_s_{out}")).over(before).alias(f"_b_{out}") for out, (agg, _) in sums.items()])
    slices = slices.where(" OR ".join(f"_b_{out} IS NOT NULL" for out in sums))  # a key's first slice has none before it
    local = cut.select("*", *[agg(F.col(c)).over(inside).alias(out) for out, (agg, c) in sums.items()])
    both = local.join(slices, [key, "_slice"], "left")
    merge = lambda out, agg: F.col(out).bitwiseXOR(F.coalesce(f"_b_{out}", F.lit(0))) if agg is F.bit_xor else F.col(out) + F.coalesce(f"_b_{out}", F.lit(0))
    return both.select(*rows.columns, *[merge(out, agg).alias(out) for out, (agg, _) in sums.items()])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbered turns ``conv, rank, a, b, words``: the conversations ``conv, len``, and the rebuilt turns
    ``conv, pos, len, words, k1, k2, p1, p2``: keys of the node at the turn and of its parent."""
    total = turns.count()
    base = F.col("conv") - F.col("conv") % BASE
    heads = turns.where((F.col("rank") < HEADS) & (F.col("conv") == base)).select(F.col("conv").alias("base"), F.col("rank").alias("pos"), "a", "b", "words")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("base", base).withColumn("h", F.crc32(F.col("conv").cast("string")) % HEADS)
    convs = convs.join(heads.groupBy("base").agg(F.count(F.lit(1)).alias("held")), "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("held", F.lit(0)))).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv", "base", "n", "h", "k", "len"), "trie-convs")
    shared = convs.join(heads, "base").where(F.col("pos") <= F.col("k")).select("conv", "pos", "len", "a", "b", "words")
    own = lookup(turns, convs, ["conv"], ["h", "k", "len"], "n", total, "rank").where(F.col("rank") > F.col("h"))
    own = own.select("conv", (F.col("k") + F.col("rank") - F.col("h")).alias("pos"), "len", "a", "b", "words")
    placed = shared.unionByName(own).withColumns({"z1": F.xxhash64("a", "pos", F.lit(1)), "z2": F.xxhash64("b", "pos", F.lit(2))}).drop("a", "b")
    keyed = running(placed, "conv", F.col("pos"), {"k1": (F.bit_xor, "z1"), "k2": (F.bit_xor, "z2")})
    parent = {"p1": F.col("k1").bitwiseXOR(F.col("z1")), "p2": F.col("k2").bitwiseXOR(F.col("z2"))}
    return convs, materialize(keyed.withColumns(parent).drop("z1", "z2"), "trie-turns")


def trie_nodes(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``pos, k1, k2, conv_id, parent, n_convs, n_children, saved, size``: ``saved`` without the subtree; ``size`` bounds its nodes."""
    inner = rebuilt.groupBy("pos", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum(F.col("len") - F.col("pos") + 1).alias("size"),
    )
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("len").alias("size")).where(F.col("n_convs") > 0)
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("words"), none.alias("p1"), none.alias("p2"), "size")
    nodes = materialize(inner.unionByName(root), "trie-nodes")
    up = nodes.where(F.col("pos") > 0).withColumn("up", F.col("pos") - 1)
    kids = up.groupBy(F.col("up").alias("pos"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    kids = materialize(kids, "trie-kids")
    parents = nodes.join(kids, ["pos", "k1", "k2"]).select(F.col("pos").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"), "n_children")
    named = lookup(up, parents, ["up", "p1", "p2"], ["parent"], "n_children", up.count(), "k1").drop("up")
    named = named.unionByName(nodes.where(F.col("pos") == 0).withColumn("parent", none))
    named = named.join(kids, ["pos", "k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("words")
    return materialize(named.select("pos", "k1", "k2", "conv_id", "parent", "n_convs", "n_children", saved.alias("saved"), "size"), "trie-named")


# ---- time-forward processing -----------------------------------------------------------
class SpillingQueue:
    """Priority queue of messages ``(-level, id, leaves, saved)``: beyond ``limit`` in memory they go to a sorted run on disk,
    and the runs are merged as they are read."""

    def __init__(self, limit: int = 0):
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # the next message of each run, with the run
        self.runs: list = []
        self.limit = limit or QUEUE

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.heap.sort()
            self.runs.append(self._read(self._write(self.heap)))
            self.heap = []
            self._next(len(self.runs) - 1)

    @staticmethod
    def _write(messages: list[tuple]):
        file = tempfile.TemporaryFile()
        np.array(messages, np.int64).tofile(file)
        file.flush()
        return file

    @staticmethod
    def _read(file, block: int = 4096):
        with file:
            file.seek(0)
            while data := file.read(block * 32):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())

    def _next(self, run: int) -> None:
        message = next(self.runs[run], None)
        if message is not None:
            heapq.heappush(self.heads, (message, run))

    def take(self, level: int, name: int) -> tuple[int, int]:
        """Removes the messages to a node, which must be the first in the queue, and adds them up."""
        leaves = saved = 0
        while True:
            if self.heap and self.heap[0][0] == -level and self.heap[0][1] == name:
                message = heapq.heappop(self.heap)
            elif self.heads and self.heads[0][0][0] == -level and self.heads[0][0][1] == name:
                message, run = heapq.heappop(self.heads)
                self._next(run)
            else:
                return leaves, saved
            leaves, saved = leaves + message[2], saved + message[3]


FORWARD = ["level", "name", "up_level", "up", "leaves", "saved"]


def time_forward(batches):
    """Rows (``FORWARD`` and any others) in reverse level order, with the totals of their subtrees in ``leaves`` and
    ``saved``; a row without ``up`` sends its total nowhere."""
    queue = SpillingQueue()
    for batch in batches:
        at = {n: batch.schema.get_field_index(n) for n in FORWARD}
        leaves, saved = [], []
        for level, name, up_level, up, leaf, own in zip(*[batch.column(at[n]).to_pylist() for n in FORWARD], strict=True):
            below, more = queue.take(level, name)
            leaf, own = leaf + below, own + more
            leaves.append(leaf)
            saved.append(own)
            if up is not None:
                queue.push((-up_level, up, leaf, own))
        batch = batch.set_column(at["leaves"], "leaves", pa.array(leaves, pa.int64()))
        yield batch.set_column(at["saved"], "saved", pa.array(saved, pa.int64()))


def _forward(rows: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.sortWithinPartitions(F.desc("level"), "name").mapInArrow(time_forward, schema)


def subtree_totals(nodes: DataFrame, rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` of their subtrees."""
    n = rebuilt.count()
    bound = SHARD * math.ceil(math.sqrt(max(n, 1)))
    on_top = (F.col("pos") == 0) | (F.col("size") > bound)
    keys = ["pos", "k1", "k2"]
    top = nodes.where(on_top)
    # each conversation's shard: its path's first node below the top
    deepest = lookup(rebuilt.select("conv", *keys), top.where(F.col("pos") > 0), keys, ["size"], "n_convs", max(n, 1), "conv", "inner").groupBy("conv").agg(F.max("pos").alias("cut"))
    start = convs.select("conv").join(deepest, "conv", "left").select("conv", (F.coalesce("cut", F.lit(0)) + 1).alias("pos"))
    shards = rebuilt.join(start, ["conv", "pos"]).select(F.col("conv").alias("conv_id"), F.xxhash64(*keys).alias("shard"), F.col("pos").alias("root_pos"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")
    kept = [*keys, "conv_id", "parent", "n_convs", "n_children"]
    below = nodes.where(~on_top).join(shards, "conv_id")
    is_root = F.col("pos") == F.col("root_pos")
    below = below.select(*kept, "saved", leaf, F.col("pos").alias("level"), F.col("conv_id").alias("name"), (F.col("pos") - 1).alias("up_level"),
                         F.when(~is_root, F.col("parent")).alias("up"), is_root.alias("is_root"), "shard")
    below = materialize(_forward(below.repartition("shard")), "trie-shards")
    reports = below.where("is_root").groupBy((F.col("pos") - 1).alias("pos"), F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("r_leaves"), F.sum("saved").alias("r_saved"))
    add = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    top = top.select(*kept, "saved", leaf).join(reports, ["pos", "conv_id"], "left")
    top = materialize(top.select(*kept, add("saved", "r_saved"), add("leaves", "r_leaves")), "trie-top")
    # runs of the top that one conversation names, and what they report to the run above
    runs = top.groupBy("conv_id").agg(F.min("pos").alias("level"), F.min_by("parent", "pos").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    runs = materialize(runs, "trie-runs")
    above = runs.select(F.col("conv_id").alias("up"), F.col("level").alias("up_level"))
    told = runs.withColumnRenamed("conv_id", "name").join(above, "up", "left").select(*FORWARD)
    told = materialize(_forward(told.repartition(1)), "trie-run-totals")
    sides = told.where(F.col("up").isNotNull()).groupBy((F.col("level") - 1).alias("pos"), F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("r_leaves"), F.sum("saved").alias("r_saved"))
    top = top.join(sides, ["pos", "conv_id"], "left").select(*kept, add("saved", "r_saved").alias("s"), add("leaves", "r_leaves").alias("l"))
    top = running(top, "conv_id", -F.col("pos"), {"leaves": (F.sum, "l"), "saved": (F.sum, "s")})
    out = [*kept, "leaves", "saved"]
    return below.select(*out).unionByName(top.select(*out))


def end_digests(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``pos, k1, k2, ends_sha256`` of the nodes where conversations end."""
    zero = F.lit(0).cast("long")
    ends = rebuilt.where(F.col("pos") == F.col("len")).select("pos", "k1", "k2", "conv")
    ends = ends.unionByName(convs.where(F.col("len") == 0).select(zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), "conv"))
    keys = ["pos", "k1", "k2"]

    def packed(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in columns[:3]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, batch.num_rows))
            starts = np.concatenate([np.empty(0, np.int64), *[np.arange(a, a + n, ENDS) for a, n in zip(first.tolist(), size.tolist(), strict=True)]])
            bounds = np.append(starts, batch.num_rows)
            ids = [pack(np.diff(columns[3][a:b], prepend=0)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in columns], pa.array(ids, pa.binary())], names=[*keys, "first", "ids"])

    def digests(batches):
        key, sha, some = None, None, False
        for batch in batches:
            out = []
            for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha, some = node, hashlib.sha256(), False
                text = ",".join(map(str, np.cumsum(unpack(ids, np.int64)).tolist())).encode()
                sha.update(b"," + text if some else text)
                some = True
            if out:
                yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, sha.hexdigest())])

    def _digest_rows(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])], names=[*keys, "ends_sha256"])

    rows = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    rows = rows.mapInArrow(packed, "pos long, k1 long, k2 long, first long, ids binary")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "pos long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row per node."""
    read = materialize(turn_rows(conversations, conv_col, turn_col, role_col, text_col), "trie-read")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("uid")]
    turns = materialize(rank_within(read, ["conv"], order).select("conv", "rank", "a", "b", "words"), "trie-ranked")
    convs, rebuilt = rebuilt_turns(turns)
    nodes = trie_nodes(convs, rebuilt)
    totals = subtree_totals(nodes, rebuilt, convs)
    out = totals.join(end_digests(convs, rebuilt), ["pos", "k1", "k2"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
