"""Prefix trie of conversations with subtree totals by time-forward processing.

Every turn has a rolling hash (128 bits, exclusive or of hashes that hold place, role and text), so a
trie node is a group of equal (depth, hash). Nodes with the same members form an unbranched run, which
is known by (smallest member, number of members) and becomes one vertex; byte sums along a run are
differences of running sums. Totals then go up the tree of runs by time-forward processing:

* Runs with more than M members are the top (M grows with the square root of the rows, so the top has
  at most about that many runs: every row lies in one run). Below it hang small subtrees, each with at
  most M members and so at most 2 M runs; its first run is a shard root. A shard is a Spark partition
  that holds whole small subtrees.
* In a shard, runs are sorted by Spark in reverse level order (external sort) and read as a stream. A
  run takes its children's totals from a priority queue, adds its own and sends the sum to its parent
  through the queue. The queue spills sorted runs of messages beyond `QUEUE` entries.
* Messages of shard roots to the top are summed per receiver and the same pass goes over the top.

Member ids of a node's ends are joined in pieces of ids that share all but their lowest 12 bits (so a
piece is bounded), sorted, and hashed as a stream.

Turns are numbered and summed in range slices (one huge conversation is spread over tasks), and the
receivers that very many rows name are looked up in the top, which is broadcast; its bound is above.

Defined results: turns are in the order of turn (null first) and, among equal turns, of a hash of role
and text; repeated turns count; null role or text is empty; rows without conv_id are left out; no rows
give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.llm.common import blocks, cut_lineage, read
from shortlist.llm.registry import query

FAMILY = 5  # conversations of one family share a base: the conv_id that is a multiple of this
HEADS = 9  # a conversation takes crc32(conv_id) modulo this many turns of its base
SLICE_ROWS = 200_000
LEAST_TOP = 500  # M is at least this
HEAVY_TURNS = 100_000
QUEUE = 200_000
SHARD_RUNS = 50_000
_PIECE_BITS = 12

_NODE = ["depth", "p1", "p2"]
_PARENT = ["up_depth", "up1", "up2"]


def _running(df: DataFrame, order: list[Column], out: dict[str, tuple]) -> DataFrame:
    """Running aggregates per conv_id in an order, over range slices. `out` names (aggregate, value, join
    of an earlier slice's result with the local one)."""
    count = blocks(df.count(), SLICE_ROWS, 8)
    sliced = cut_lineage(df.repartitionByRange(count, F.col("conv_id").asc(), *order).withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy("_slice", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.groupBy("_slice", "conv_id").agg(*[f(v).alias(f"_{n}") for n, (f, v, _) in out.items()])
    before = held.select("_slice", "conv_id", *[f(f"_{n}").over(earlier).alias(f"_{n}") for n, (f, _, _) in out.items()])
    before = before.where(F.col(f"_{next(iter(out))}").isNotNull())  # at most one conversation per slice edge
    local = sliced.select("*", *[f(v).over(inside).alias(n) for n, (f, v, _) in out.items()])
    joined = local.join(F.broadcast(before), ["_slice", "conv_id"], "left")
    whole = [F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(add(F.col(n), F.col(f"_{n}"))).alias(n) for n, (_, _, add) in out.items()]
    return joined.select(*df.columns, *whole)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, c1, c2, n_bytes): every turn's place from 1 on, content hashes and text bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    # rows equal in all of these are the same turn twice, so their order does not matter
    order = [F.col("turn").asc_nulls_first(), F.col("c1").asc(), F.col("c2").asc()]
    return _running(rows, order, {"place": (F.sum, F.lit(1).cast("long"), lambda a, b: a + b)}).drop("turn")


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with turns of their family's base: (conv_id, depth, c1, c2, n_bytes)."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.select("conv_id").distinct().select("conv_id", base.alias("base"), head.alias("head"))
    # at most HEADS - 1 turns of a base, each taken by at most 2 FAMILY - 1 conversations
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), "place", "c1", "c2", "n_bytes")
    taken = convs.join(heads, "base").where(F.col("place") <= F.col("head")).select("conv_id", F.col("place").alias("depth"), "c1", "c2", "n_bytes")
    there = heads.groupBy("base").agg(F.max("place").alias("held"))
    # conversations whose base is shorter than their head move their own turns up
    missing = convs.join(there, "base", "left").select("conv_id", (F.col("head") - F.coalesce("held", F.lit(0))).alias("by")).where("by > 0")
    lengths = own.groupBy("conv_id").agg((F.max("place") > HEAVY_TURNS).alias("heavy"))
    moved = _join_by_weight(own.where(F.col("place") > head), missing.join(lengths, "conv_id"), ["conv_id"])
    return taken.unionByName(moved.select("conv_id", (F.col("place") - F.coalesce("by", F.lit(0))).alias("depth"), "c1", "c2", "n_bytes"))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per (conversation, depth), depth 0 included: hash of the prefix, of the one before, byte sums."""
    rows = turns.select(
        "conv_id", "depth", F.xxhash64(F.lit(1), "depth", "c1").alias("t1"), F.xxhash64(F.lit(2), "depth", "c2").alias("t2"), "n_bytes"
    )
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(convs.select("conv_id", *[zero.alias(c) for c in ("depth", "t1", "t2", "n_bytes")]))
    run = _running(
        rows,
        [F.col("depth").asc()],
        {
            "p1": (F.bit_xor, F.col("t1"), lambda a, b: a.bitwiseXOR(b)),
            "p2": (F.bit_xor, F.col("t2"), lambda a, b: a.bitwiseXOR(b)),
            "bytes_so_far": (F.sum, F.col("n_bytes"), lambda a, b: a + b),
        },
    )
    return run.select(
        "conv_id", *_NODE, (F.col("depth") - 1).alias("up_depth"), F.col("p1").bitwiseXOR(F.col("t1")).alias("up1"),
        F.col("p2").bitwiseXOR(F.col("t2")).alias("up2"), "n_bytes", "bytes_so_far",
    )


class Messages:
    """A priority queue of (depth, receiver, ..) messages, deepest receiver first, that keeps at most
    `limit` in memory: beyond, all it holds goes to a sorted run in a file without a name, which the
    system takes back with the task."""

    _PACK = "<qqqqqq"

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spills = limit, [], [], 0

    def put(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            for kept in sorted(self.heap):
                file.write(struct.pack(self._PACK, *kept))
            file.seek(0)
            self.heap = []
            self.spills += 1
            self._next(file)

    def _next(self, file) -> None:
        data = file.read(struct.calcsize(self._PACK))
        if data:
            heapq.heappush(self.runs, (struct.unpack(self._PACK, data), id(file), file))
        else:
            file.close()

    def peek(self):
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, _, file = heapq.heappop(self.runs)
            self._next(file)
            return message
        return heapq.heappop(self.heap)


_SENT = "conv long, n long, leaves long, saved long, below long, upward boolean"


def time_forward(limit: int = QUEUE):
    """A pass for mapInArrow over rows (conv, n, depth, up_conv, up_n, up_depth, own, leaves, saved, inside)
    sorted by depth, deepest first, and by conv and n. Gives each run's totals and, marked upward, one
    message per receiver outside. The rows leaves and saved are what came in from other shards."""

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.bool_() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows))],
            ["conv", "n", "leaves", "saved", "below", "upward"],
        )

    def run(batches):
        queue, outside, out = Messages(limit), {}, []
        for batch in batches:
            for conv, n, depth, up_conv, up_n, up_depth, own, leaves, below, inside in zip(*[c.to_pylist() for c in batch.columns]):
                key = (-depth, conv, n)
                while (first := queue.peek()) is not None and first[:3] <= key:
                    message = queue.pop()
                    if message[:3] != key:
                        raise RuntimeError("a message came after its receiver")
                    leaves += message[3]
                    below += message[4]
                leaves = leaves or 1
                out.append((conv, n, leaves, below + own, below, False))
                if inside:
                    queue.put((-up_depth, up_conv, up_n, leaves, below + own, 0))
                elif up_conv is not None:
                    held = outside.setdefault((up_conv, up_n), [0, 0])
                    held[0] += leaves
                    held[1] += below + own
                if len(out) >= 20_000:
                    yield emit(out)
                    out = []
        if queue.peek() is not None:
            raise RuntimeError("a message without a receiver")
        out += [(c, n, leaves, saved, 0, True) for (c, n), (leaves, saved) in outside.items()]
        if out:
            yield emit(out)

    return run


_RUN = ["conv", "n", "depth", "up_conv", "up_n", "up_depth", "own"]


def _up_tree(rows: DataFrame, limit: int) -> DataFrame:
    return rows.sortWithinPartitions(F.col("depth").desc(), "conv", "n").mapInArrow(time_forward(limit), _SENT)


def run_totals(runs: DataFrame, shards: int, limit: int = QUEUE) -> DataFrame:
    """(conv, n, leaves, below) of each run: leaves in its subtree, bytes saved under it. `runs` has _RUN,
    `top`, `up_top` and `shard`, the shard root's key for runs outside the top."""
    zero = F.lit(0).cast("long")
    small = runs.where(~F.col("top")).repartition(shards, "shard")
    low = cut_lineage(_up_tree(small.select(*_RUN, zero.alias("leaves"), zero.alias("below"), (F.col("up_conv").isNotNull() & ~F.col("up_top")).alias("inside")), limit))
    came = low.where("upward").groupBy("conv", "n").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
    top = runs.where("top").join(F.broadcast(came), ["conv", "n"], "left")
    high = _up_tree(
        top.select(*_RUN, F.coalesce("leaves", zero).alias("leaves"), F.coalesce("below", zero).alias("below"), F.col("up_conv").isNotNull().alias("inside")).repartition(1),
        limit,
    )
    return low.where(~F.col("upward")).unionByName(high).select("conv", "n", "leaves", "below")


def _join_by_weight(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a written table to one with unique keys. Keys it marks `heavy` may be those of very many
    rows; they are fewer than rows / M, hence broadcast. Each of the others has at most M rows."""
    heavy = table.where("heavy").withColumn("_met", F.lit(True)).drop("heavy")
    met = rows.join(F.broadcast(heavy), on, "left")
    light = met.where(F.col("_met").isNull()).select(*rows.columns).join(table.where("not heavy").drop("heavy"), on, "left")
    return met.where("_met").drop("_met").unionByName(light)


def end_hashes(ends: DataFrame, parts: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 over the ascending ids of the conversations that end there."""
    pieces = ends.groupBy(*_NODE, F.shiftright("conv_id", _PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ordered = pieces.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "piece")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *at, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if at != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = at, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], [*_NODE, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], [*_NODE, "ends_sha256"])

    return ordered.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, most: int | None = None, queue: int = QUEUE, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Nodes of the trie of `rows` (conv_id, depth, p1, p2, up_depth, up1, up2, n_bytes, bytes_so_far), as
    `prefixes` gives them, with members, children, leaves, saved bytes and the hash of their ends."""
    rows = cut_lineage(rows)
    count = rows.count()
    most = most or max(LEAST_TOP, int(count**0.5))
    parts = blocks(count, SLICE_ROWS, 8)
    nodes = rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in (*_PARENT, "n_bytes", "bytes_so_far")]
    )
    nodes = cut_lineage(nodes.withColumn("top", F.col("n_convs") > most))
    top = nodes.where("top")  # fewer than count / most nodes: every row is in one node
    parents = nodes.select(
        *[F.col(c).alias(u) for c, u in zip(_NODE, _PARENT)], F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("top").alias("heavy")
    )
    named = cut_lineage(_join_by_weight(nodes, parents, _PARENT))

    # one vertex per run: its first node has the parent, its last the byte sum
    first = F.min(F.struct("depth", "up_conv", "up_n", (F.col("bytes_so_far") - F.col("n_bytes")).alias("before")))
    runs = named.groupBy(F.col("conv_id").alias("conv"), F.col("n_convs").alias("n"), "top").agg(
        first.alias("first"), F.max("depth").alias("depth"), F.max("bytes_so_far").alias("last"), (F.count(F.lit(1)) > most).alias("heavy")
    )
    runs = runs.select(
        "conv", "n", "top", "depth", F.col("first.up_conv").alias("up_conv"), F.col("first.up_n").alias("up_n"), F.col("first.depth").alias("first_depth"),
        ((F.col("n") - 1) * (F.col("last") - F.col("first.before"))).alias("own"), "last", "heavy",
    )
    # the run above ends just over this one's first node
    runs = runs.withColumn("up_depth", F.col("first_depth") - 1).withColumn("up_top", F.coalesce(F.col("up_n") > most, F.lit(False)))
    out_of_top = rows.join(F.broadcast(top.select(*_NODE)), _NODE, "left_anti")
    roots = out_of_top.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("root"))
    shard = F.xxhash64("root.depth", "root.p1", "root.p2")
    low = runs.where(~F.col("top")).join(roots.select(F.col("conv_id").alias("conv"), shard.alias("shard")), "conv")
    high = runs.where("top").withColumn("shard", F.lit(0).cast("long"))
    runs = cut_lineage(low.unionByName(high))
    totals = run_totals(runs.drop("last", "heavy"), blocks(runs.count(), shard_runs, 8), queue)
    ready = runs.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), "last", "heavy").join(
        totals.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), "leaves", "below"), ["conv_id", "n_convs"]
    )

    children = named.where(F.col("depth") > 0).groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("at")).select("conv_id", "at.*")
    whole = _join_by_weight(named, cut_lineage(ready), ["conv_id", "n_convs"])
    whole = whole.join(children.select(*[F.col(u).alias(c) for c, u in zip(_NODE, _PARENT)], "n_children"), _NODE, "left")
    whole = whole.join(end_hashes(ends, parts), _NODE, "left")
    under = F.col("last") - F.col("bytes_so_far") + F.col("n_bytes")
    return whole.select(
        "conv_id",
        "depth",
        F.col("up_conv").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * under).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie_of(turns: DataFrame, rebuild: bool = True, **limits) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), as they are or rebuilt on their bases."""
    own = cut_lineage(numbered(turns))
    held = rebuilt(own) if rebuild else own.withColumnRenamed("place", "depth")
    return prefix_trie(prefixes(own.select("conv_id").distinct(), held), **limits)


@query("op13_prefix_trie")
def op13_prefix_trie(spark, sf_dir):
    return trie_of(read(spark, sf_dir, "conversations"))
