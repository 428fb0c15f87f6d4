"""The trie of all prefixes of rebuilt conversations, from sorted LCPs and range minima.

A conversation is a row of turn hashes. All rows are sorted by ranges, so one frequent
first turn, or one conversation with many copies, is cut wherever a range ends. A task
streams its range in chunks; in a chunk, the common prefix of each row with its
predecessor is measured, and a sparse table answers minima over any run of them. Each
candidate prefix - a row up to its common prefix, or a whole row - binary-searches its
left and right extents on that table, independently of all others. The interval is the
prefix's members; prefixes that lie between it and the longer of the common prefixes at
its two ends have the same members.

All facts of a node are sums or minima over its interval, so a node that a chunk cuts is
put together again by one aggregate. Within a task the row before a chunk and the row
after it are known. The first row of a task is counted as if nothing came before it; what
that counts twice is taken off again by rows made from the ends of neighbouring ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfit.llm.jaccard_join import mix
from lexfit.session import stage

GROUP = 100
HEADS = 6
#: Turns (or one conversation) that a task holds at once.
CHUNK_TURNS = 1 << 18

U = np.uint64
TURN = "struct<a: bigint, b: bigint, chars: bigint>"
NODE = ["k1", "k2", "p1", "p2", "depth", "n", "low", "weight", "own", "children", "leaves"]


def conversation_rows(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (a, b, chars) in order: two hashes of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"), F.length(text).cast("long").alias("chars")).alias("t"),
    )
    rows = hashed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rows.select("conv_id", F.transform("ts", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars"))).alias("turns"))


def rebuild(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``rows`` (conv_id, turns, staged) with the first turns of each group's first conversation put before, or in place of, their own."""
    first = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    head = F.coalesce("head", F.array().cast(f"array<{TURN}>"))
    return joined.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Rows:
    """Conversations as flat arrays: ids, where each one's turns start, hashes, and running sums of characters and keys."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, chars: np.ndarray) -> None:
        self.ids, self.starts, self.a, self.b, self.chars = ids, starts, a, b, chars
        self.sizes = np.diff(starts)

    @staticmethod
    def of(ids: pa.Array, lists: pa.Array) -> Rows:
        flat = lists.flatten()
        starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()).astype(np.int64))])
        return Rows(ids.to_numpy().astype(np.int64), starts, *(np.ascontiguousarray(flat.field(c).to_numpy()).astype(np.int64) for c in ("a", "b", "chars")))

    def cut(self, low: int, high: int) -> Rows:
        a, b = self.starts[low], self.starts[high]
        return Rows(self.ids[low:high], self.starts[low : high + 1] - a, self.a[a:b], self.b[a:b], self.chars[a:b])

    def after(self, before: Rows) -> Rows:
        join = lambda x, y: np.concatenate([x, y])
        return Rows(join(before.ids, self.ids), join(before.starts, self.starts[1:] + before.starts[-1]), join(before.a, self.a), join(before.b, self.b), join(before.chars, self.chars))

    def common(self) -> np.ndarray:
        """Turns that each row shares with the row before; 0 for the first."""
        row = np.repeat(np.arange(len(self.ids)), self.sizes)
        offset = np.arange(len(row)) - self.starts[row]
        before = np.maximum(row - 1, 0)
        other = np.minimum(self.starts[before] + offset, max(len(row) - 1, 0))
        same = (row > 0) & (offset < self.sizes[before]) & (self.a == self.a[other]) & (self.b == self.b[other])
        found = self.sizes.copy()
        if len(row):
            full = np.flatnonzero(self.sizes)
            broken = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, offset), self.starts[full])
            found[full] = np.minimum(found[full], broken)
        return found

    def sums(self) -> None:
        """Running sums with one entry more than turns, so that ``prefix`` can take differences."""
        offset = (np.arange(len(self.a)) - np.repeat(self.starts[:-1], self.sizes)).astype(np.uint64)
        one, two = mix(self.a.view(np.uint64)), mix(self.b.view(np.uint64))
        self.sum1 = np.append(U(0), np.cumsum((one + mix(two)) * (mix(offset + U(1)) | U(1)), dtype=np.uint64))
        self.sum2 = np.append(U(0), np.cumsum((two ^ mix(one + U(7))) * (mix(offset + U(1 << 40)) | U(1)), dtype=np.uint64))
        self.upto = np.append(0, np.cumsum(self.chars))

    def keys(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.starts[row]
        d = depth.astype(np.uint64)
        return tuple(mix(s[start + depth] - s[start] + d).view(np.int64) for s in (self.sum1, self.sum2))

    def characters(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points of the first ``depth`` turns of each row."""
        return self.upto[self.starts[row] + depth] - self.upto[self.starts[row]]


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2**k values."""
    levels = [values]
    while 2 << len(levels) - 1 <= len(values):
        low, step = levels[-1], 1 << len(levels) - 1
        levels.append(np.minimum(low[:-step], low[step:]))
    return levels


def range_minimum(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of values[left:right], which are not empty."""
    k = np.frexp((right - left).astype(np.float64))[1] - 1
    out = np.empty(len(left), levels[0].dtype)
    for level in np.unique(k).tolist():
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << level)])
    return out


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row, and row after the last, that share at least ``depth`` with ``row``; ``levels``: of the common prefixes with the row before."""
    n = len(levels[0])
    left, right = row.copy(), row + 1
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = np.flatnonzero(left - step >= 0)
        ok = ok[levels[k][left[ok] - step + 1] >= depth[ok]]
        left[ok] -= step
        ok = np.flatnonzero(right + step <= n)
        ok = ok[levels[k][right[ok]] >= depth[ok]]
        right[ok] += step
    return left, right


def chunk_nodes(rows: Rows, shared: np.ndarray, follows: np.ndarray) -> list[np.ndarray]:
    """The columns NODE of all prefixes in a chunk, the root among them.

    ``shared``: common prefix of each row with the row before it, the first one's with the
    last row of the chunk before; ``follows``: true for rows that the next row does not start with.
    """
    n = len(rows.ids)
    rows.sums()
    inside = shared.copy()
    inside[0] = 0
    table = sparse_table(inside)
    every = np.arange(n)
    row = np.concatenate([every[inside > 0], every[rows.sizes > 0]])
    depth = np.concatenate([inside[inside > 0], rows.sizes[rows.sizes > 0]])
    left, right = extents(table, row, depth)
    stride = int(rows.sizes.max(initial=0)) + 1
    # the root is an interval like the others
    spot, at, number = np.unique(np.append(left * stride + depth, 0), return_index=True, return_inverse=True)
    left, right, depth = np.append(left, 0)[at], np.append(right, n)[at], np.append(depth, 0)[at]

    bounds = np.append(inside, 0)
    above = np.where(depth > 0, np.maximum(bounds[left], bounds[right]), -1)
    # a row that is longer than what it shares with the row before begins a child of that prefix
    begins = np.flatnonzero((every > 0) & (rows.sizes > inside))
    owner = np.searchsorted(spot, extents(table, begins, inside[begins])[0] * stride + inside[begins])
    owner[inside[begins] == 0] = 0
    children = np.bincount(owner, minlength=len(spot))

    n_levels = depth - above
    which = np.repeat(np.arange(len(spot)), n_levels)
    d = above[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(n_levels) - n_levels, n_levels)
    l, r = left[which], right[which]  # noqa: E741
    first_own = rows.characters(every, rows.sizes) - rows.characters(every, shared)
    total = np.append(0, np.cumsum(rows.characters(every, rows.sizes)))
    new = np.append(0, np.cumsum(first_own))
    leaf = np.append(0, np.cumsum(follows.astype(np.int64)))
    before = np.maximum(d - 1, 0)
    weight = total[r] - total[l] - (r - l) * rows.characters(l, before)
    own = new[r] - new[l + 1] + rows.characters(l, rows.sizes[l]) - rows.characters(l, np.maximum(before, shared[l]))
    kids = np.where(d == depth[which], children[which], 0) + ((rows.sizes[l] > d) & (d + 1 > shared[l]))
    low = range_minimum(sparse_table(rows.ids), l, r)
    return [*rows.keys(l, d), *rows.keys(l, before), d, r - l, low, weight, own, kids, leaf[r] - leaf[l]]


def node_columns(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c.astype(np.int64)) for c in columns]


def partial_nodes(rebuilt: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Partial facts of nodes, one row per chunk and node, and for each range a row with its first and last conversation; staged."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            rows = Rows.of(batch.column("conv_id"), batch.column("turns"))
            at = 0
            while at < len(rows.ids):
                end = max(at + 1, int(np.searchsorted(rows.starts, rows.starts[at] + chunk_turns, "right")) - 1)
                yield rows.cut(at, end)
                at = end

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = held = None
        held_shared = 0
        for rows in chunks(batches):
            ghost = rows.after(last) if last is not None else rows
            shared = ghost.common()[-len(rows.ids) :]
            if held is not None:
                yield finished(held, held_shared, int(shared[0]))
            first = rows.cut(0, 1) if first is None else first
            held, held_shared, last = rows, shared, rows.cut(len(rows.ids) - 1, len(rows.ids))
        if held is not None:
            yield finished(held, held_shared, -1)
            ends = [pa.array([[dict(zip(("a", "b", "chars"), t, strict=True)) for t in zip(x.a.tolist(), x.b.tolist(), x.chars.tolist(), strict=True)]], END) for x in (first, last)]
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in NODE), part, *ends], [*NODE, "part", "first", "last"])

    END = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("chars", pa.int64())]))

    def finished(rows: Rows, shared: np.ndarray, then: int) -> pa.RecordBatch:
        columns = node_columns(chunk_nodes(rows, shared, np.append(shared[1:], then) < rows.sizes))
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, END), pa.nulls(n, END)], [*NODE, "part", "first", "last"])

    schema = ", ".join(f"{c} long" for c in NODE) + f", part long, first array<{TURN}>, last array<{TURN}>"
    ordered = rebuilt.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    return stage(ordered.mapInArrow(build, schema), "trie-parts")


def corrections(parts: DataFrame) -> DataFrame:
    """What the first row of a range counted twice, as rows to be added to the partial nodes."""
    ranges = stage(parts.where("part is not null").select("part", "first", "last"), "trie-ranges")
    order = ranges.select("part").withColumn("before", F.lag("part").over(Window.orderBy("part")))  # a number per range
    pairs = ranges.select("part", "first").join(order.where("before is not null"), "part")
    pairs = pairs.join(ranges.select(F.col("part").alias("before"), "last"), "before").select("last", "first")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                two = pa.concat_arrays([batch.column("last").slice(row, 1), batch.column("first").slice(row, 1)])
                rows = Rows.of(pa.array([0, 0]), two)
                shared = int(rows.common()[1])
                rows.sums()
                d = np.arange(shared + 1)
                at, zero = np.ones(len(d), np.int64), np.zeros(len(d), np.int64)
                before = np.maximum(d - 1, 0)
                twice = rows.characters(at, np.full(len(d), shared)) - rows.characters(at, before)
                ended = np.full(len(d), int(rows.sizes[0] <= shared))
                yield pa.RecordBatch.from_arrays(node_columns([*rows.keys(at, d), *rows.keys(at, before), d, zero, zero, zero, -twice, -(d < shared).astype(np.int64), -ended]), NODE)

    made = pairs.mapInArrow(build, ", ".join(f"{c} long" for c in NODE))
    return made.withColumn("low", F.lit(None).cast("long"))


def member_digests(rebuilt: DataFrame) -> DataFrame:
    """k1, k2 and the digest of the ids of all conversations that are equal to a prefix.

    The ids of one prefix are streamed in order through one digest, which holds no more than its state.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows.of(batch.column("conv_id"), batch.column("turns"))
            rows.sums()
            keys = rows.keys(np.arange(len(rows.ids)), rows.sizes)
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(rows.ids)], ["k1", "k2", "conv_id"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            edges = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[: len(k1)]).tolist()
            done = []
            for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
                text = ",".join(map(str, ids[a:b].tolist())).encode()
                if key == (k1[a], k2[a]):
                    state.update(b"," + text)
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1[a], k2[a]), hashlib.sha256(text)
            yield ended(done)
        if key is not None:
            yield ended([(*key, state.hexdigest())])

    def ended(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["k1", "k2", "digest"])

    members = rebuilt.mapInArrow(keyed, "k1 long, k2 long, conv_id long")
    return members.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(digest, "k1 long, k2 long, digest string")


def trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row per node of the trie of ``turns`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    * null role or text: empty; null turn: before all others; turns of equal number: by role, then by hash
    * null conv_id: such rows belong to no conversation and are left out; repeated rows: repeated turns
    * a conversation without turns is a member of the root; no conversations: no rows, not even the root
    * columns other than these four are not looked at; texts of any length are read whole
    * a conversation is one row of 24 bytes a turn, whatever its texts
    """
    rows = stage(conversation_rows(turns), "trie-rows")
    rebuilt = stage(rebuild(rows, group, heads), "trie-rebuilt")
    parts = partial_nodes(rebuilt)
    every = parts.where("part is null").select(*NODE).unionByName(corrections(parts))
    sums = [F.sum(c).alias(c) for c in ("n", "weight", "own", "children", "leaves")]
    nodes = every.groupBy("k1", "k2").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("low").alias("low"), *sums)
    nodes = stage(nodes.join(member_digests(rebuilt), ["k1", "k2"], "left"), "trie-nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["p1", "p2"])
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = below.unionByName(top)
    return out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("weight") - F.col("own")).alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
