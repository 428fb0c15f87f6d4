"""Similarity join on word shingles by adaptive multi-match prefixes.

A document is its set of shingles of five words. If two sets are similar, any order of
all shingles in which both are cut to their first ``n - need + l`` shares at least ``l``
shingles there, ``need`` being the least overlap with any partner. Rare shingles come
first in the order, by a sketch of how often each occurs in the whole corpus. Each
document picks its own ``l``: a longer prefix costs more index entries but lets fewer
candidates through, and the pick is the cheapest by the estimated lengths of the lists
it touches. A pair is verified if it shares as many prefix shingles as the smaller ``l``.

Documents with equal sets are one class, so copies are never paired. Classes are linked
in two steps: first each with the class of its lists that has the most entries in lists,
and with the lowest, which ties groups of near copies together without pairing their
members (the least edited copy shares most with the others); then classes of different
components that a list holds. A list inside one component is left out.

In the second step lists with the same members, as a shared passage makes them, are one
list that counts as often. No pair of a list is made before it is known to be possible. Each
set has a bitmap of its hashes, four bits a hash or more. Where two bitmaps differ, the sets do,
so two sets that differ in more bits than links may differ in shingles are no link, for
sure. The entries of a list are compared by their bitmaps in blocks of LIST_BLOCK, and
only what is left leaves the task. A long list is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfit.llm import sketch
from lexfit.llm.common import grouped
from lexfit.llm.graph import components
from lexfit.operators.joins import value_filter
from lexfit.session import stage

WORDS = 5
PERCENT = 80
SKETCH_BITS = 22
ID_BITS = 22
#: What may be picked for ``l``.
MATCHES = np.array([1, 2, 3, 4, 6, 8, 12, 16])
#: Least and greatest number of bits of a set's bitmap.
LEAST_BITS, MOST_BITS = 128, 1 << 17
#: Entries of a list that are compared with each other in one task.
LIST_BLOCK = 1024
#: Pairs of entries that are looked at together.
PAIRS_AT_ONCE = 1 << 17
#: Cost of an index entry and of a verification, in probes of a list; length of a list too short for the sketch to tell.
ENTRY_COST, VERIFY_COST, SHORT_LIST = 0.2, 20.0, 0.5

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
PLACES = mix(np.arange(301, 301 + WORDS, dtype=np.uint64) * U(BASE)) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 2 * n)
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; with fewer words, of the whole sequence; empty without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    edges = np.flatnonzero(np.diff(IS_SPACE[raw].astype(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up, out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if len(words) < WORDS:
        return mix(np.array([(words * PLACES[: len(words)]).sum() + U(len(words))], np.uint64))
    last = len(words) - WORDS + 1
    found = words[:last] * PLACES[0]
    for k in range(1, WORDS):
        found = found + words[k : k + last] * PLACES[k]
    return np.unique(mix(found))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    two = (mix(found ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(found + U(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return tuple(int(x.astype(np.int64)) for x in two)


def prefix(found: np.ndarray, counts: np.ndarray, background: float) -> tuple[int, np.ndarray]:
    """``l`` and the prefix of a set, by the counts of its shingles' slots."""
    n = len(found)
    need = -(-PERCENT * n // 100)
    often = counts[sketch.slots(found, int(np.log2(len(counts))))]
    order = np.lexsort((found, often))
    lists = np.cumsum(np.maximum(often[order] - background, SHORT_LIST))
    allowed = MATCHES[MATCHES <= need]
    sizes = n - need + allowed
    probes = lists[sizes - 1]
    best = int(np.argmin(sizes * ENTRY_COST + probes + probes / allowed * VERIFY_COST))
    return int(allowed[best]), found[order[: sizes[best]]]


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each hash, at its low bits; at least four times as many bits as hashes, up to MOST_BITS."""
    width = min(max(LEAST_BITS, 1 << int(4 * len(found) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(width, np.uint8)
    bits[(mix(found) & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: bytes, n: int, width: int) -> np.ndarray:
    """``n`` bitmaps of one width, cut down to ``width`` bytes each: a half as wide one is the halves put together."""
    rows = np.frombuffer(maps, np.uint8).reshape(n, -1)
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return np.ascontiguousarray(rows).view(np.uint64)


def near_enough(both: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """False if two sets with ``both`` elements in sum, of which ``differ`` at least are in one only, are no link."""
    # their overlap is at most (both - differ) / 2; similar if 100 overlap >= PERCENT (both - overlap)
    return (100 + PERCENT) * (both - differ) >= 2 * PERCENT * both


def differing_bits(maps: pa.Array, others: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits maps[i] and others[j] differ at the lesser of their widths."""
    wide, high = pc.binary_length(maps).to_numpy(), pc.binary_length(others).to_numpy()
    out = np.zeros(len(i), np.int64)
    kinds = wide[i].astype(np.int64) << 32 | high[j]
    for kind in np.unique(kinds).tolist():
        p, q = kind >> 32, kind & 0xFFFFFFFF
        tables, places = [], []
        for column, widths, width in ((maps, wide, p), (others, high, q)):
            rows = np.flatnonzero(widths == width)
            tables.append(folded(b"".join(column.take(pa.array(rows)).to_pylist()), len(rows), min(p, q)))
            place = np.zeros(len(widths), np.int64)
            place[rows] = np.arange(len(rows))
            places.append(place)
        at = np.flatnonzero(kinds == kind)
        step = max(1, (1 << 23) // min(p, q))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            out[own] = np.bitwise_count(tables[0][places[0][i[own]]] ^ tables[1][places[1][j[own]]]).sum(1, dtype=np.int64)
    return out


def pairs_inside(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) with i < j < ends[i], in slices; ``ends`` is where the group of each row ends."""
    n = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(n)
    at = 0
    while at < len(ends):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")))
        own = n[at:end]
        i = np.repeat(np.arange(at, end), own)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = end


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate(arrays)) if len(arrays) else np.zeros(0, np.int64)))


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row per document: row, doc_id, n, fingerprint (f, g), l, the bitmap and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    background = float(counts.mean())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch, texts in grouped(batches):
            sets = [shingles(t) for t in texts]
            picked = [prefix(s, shared.value, background) if len(s) else (0, s) for s in sets]
            prints = [fingerprint(s) for s in sets]
            cols = [pa.array(np.arange(row, row + len(sets))), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64())]
            cols += [pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]
            cols += [pa.array([x[0] for x in picked], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary()), lists_of([x[1] for x in picked])]
            row += len(sets)
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "f", "g", "l", "bitmap", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"row long, doc_id {kind}, n long, f long, g long, l int, bitmap binary, prefix array<long>")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node (a doc_id), f and shingles of the documents whose id is in ``ids`` (node), and of a few more."""

    wanted = docs.sparkSession.sparkContext.broadcast(sketch.flags(ids.select(F.xxhash64("node")), ID_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(sketch.holds(wanted.value, batch.column("h"), ID_BITS)))
            for part, texts in grouped(iter([own])):
                sets = [shingles(t) for t in texts]
                prints = pa.array([fingerprint(s)[0] for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints, lists_of(sets)], ["node", "f", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return rows.mapInArrow(pick, f"node {kind}, f long, shingles array<long>")


def links(pairs: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of the staged pairs (a, b) whose sets are similar; only their documents are read again."""
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-nodes")
    sets = sets_of(docs, nodes).join(facts.join(nodes, "node", "left_semi").select("node", "f"), ["node", "f"], "left_semi")
    sets = stage(sets, "join-sets")
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    similar = 100 * both >= PERCENT * (F.size("s") + F.size("t") - both)
    return pairs.join(first, "a").join(second, "b").where(similar).select("a", "b")


def similar_size(n: str, m: str) -> F.Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def possible(n: str, m: str, x: str, y: str) -> F.Column:
    """False for two sets of sizes n and m whose bitmaps show that they are no link."""

    @F.arrow_udf("boolean")
    def held(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        every = np.arange(len(n))
        return pa.array(near_enough(n.to_numpy() + m.to_numpy(), differing_bits(x, y, every, every)))

    return held(n, m, x, y)


def list_pairs(lists: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Pairs (a, b) of entries of the staged ``lists`` (shingle, times, component, node, n, l, bitmap) that may be links.

    Each comes once for every list of both, with the list's times and the smaller l. A list of more than ``block`` entries
    is cut into blocks by a hash of the node, and each two of its blocks meet in a group of their own.
    """
    blocks = lists.groupBy("shingle").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    long = blocks.where("blocks > 1")
    cut = lists.join(long, "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("shingle", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "times", "component", "node", "n", "l", "bitmap")
    keys = ["shingle", "low", "high"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([*(rest.to_batches() if rest else []), batch])
            ends = group_ends(rows)
            done = int(np.searchsorted(ends, len(ends)))  # the last group may go on in the next batch
            yield from pairs_of(rows.slice(0, done), ends[:done])
            rest = rows.slice(done)
        if rest:
            yield from pairs_of(rest, group_ends(rest))

    def group_ends(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for key in keys:
            column = rows.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.append(np.flatnonzero(new), rows.num_rows)
        return starts[np.searchsorted(starts, np.arange(rows.num_rows), "right")]

    def pairs_of(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        column = {c: rows.column(c).chunk(0) for c in rows.column_names}
        low, high, at, times, n, l = (column[c].to_numpy() for c in ("low", "high", "at", "times", "n", "l"))  # noqa: E741
        parts = column["component"].dictionary_encode().indices.to_numpy()
        for i, j in pairs_inside(ends):
            ok = (parts[i] != parts[j]) & ((low[i] == high[i]) | (at[i] != at[j]))
            ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = near_enough(n[i] + n[j], differing_bits(column["bitmap"], column["bitmap"], i, j))
            i, j = i[ok], j[ok]
            if len(i):
                cols = [column["node"].take(pa.array(i)), column["node"].take(pa.array(j)), pa.array(times[i]), pa.array(np.minimum(l[i], l[j]), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "times", "least"])

    kind = lists.schema["node"].dataType.simpleString()
    met = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, f"a {kind}, b {kind}, times long, least int")
    # a pair may come in either order
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "times", "least")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``, of which doc_id and text are read.

    * null, empty and blank texts: no shingles, a component of their own
    * null doc_id: n_shingles is given, component_id is null, linked with nothing
    * repeated rows: the same result each; an id with several texts links by the text of each row
    * no rows: no rows; texts of any length are read whole
    """
    docs = docs.select("doc_id", "text")

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts in grouped(iter([batch]), 1 << 22):
            yield np.concatenate([shingles(t) for t in texts])

    counts = sketch.count(docs.select("text"), hashed, SKETCH_BITS)
    rows = stage(prefixes(docs, counts), "join-prefixes")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = stage(
        usable.groupBy("f", "g", "n").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("f", "g", "n", F.col("m.doc_id").alias("node"), F.col("m.row").alias("row")),
        "join-classes",
    )
    entries = usable.select("row", "prefix").join(classes.select("row", "node"), "row").select("node", F.explode("prefix").alias("shingle"))
    held = stage(entries.groupBy("shingle").count().where("count > 1").select("shingle"), "join-shared")
    lists = stage(entries.join(held, "shingle"), "join-lists")
    facts = stage(usable.select("row", "n", "l", "bitmap").join(classes.select("row", "node", "f"), "row").select("node", "f", "n", "l", "bitmap"), "join-facts")
    size_of = facts.select("node", "n", "bitmap")
    degrees = stage(lists.groupBy("node").agg(F.count("*").alias("degree")), "join-degrees")
    held_by = lists.join(degrees, "node")
    ends = held_by.groupBy("shingle").agg(F.max(F.struct("degree", "node"))["node"].alias("most"), F.min("node").alias("low"))
    near = lists.join(ends, "shingle").select("node", F.explode(F.array("most", "low")).alias("hub")).where("node <> hub")
    near = near.groupBy("node", "hub").count()
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "hub"))
    near = near.withColumn("place", best).where("place <= 2").select(F.col("node").alias("a"), F.col("hub").alias("b"), "count")
    near = near.join(size_of.toDF("a", "n", "x"), "a").join(size_of.toDF("b", "m", "y"), "b").where(similar_size("n", "m"))
    # pairs that share almost nothing of their prefixes are left to the second step
    near = stage(near.where("100 * count >= n").where(possible("n", "m", "x", "y")).select("a", "b"), "join-near")
    first = stage(links(near, docs, facts), "join-links")
    tied = components(first)

    lists = lists.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = stage(lists, "join-parts")
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    mixed = lists.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), *members)
    mixed = mixed.where("low <> high").groupBy("size", "m1", "m2").agg(F.min("shingle").alias("shingle"), F.count("*").alias("times"))
    mixed = lists.join(mixed.select("shingle", "times"), "shingle").join(facts.select("node", "n", "l", "bitmap"), "node")
    candidates = list_pairs(stage(mixed.select("shingle", "times", "component", "node", "n", "l", "bitmap"), "join-mixed"))
    candidates = candidates.groupBy("a", "b").agg(F.sum("times").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")
    more = stage(links(stage(candidates, "join-candidates"), docs, facts), "join-more")
    tied = components(first.unionByName(more)) if not more.isEmpty() else tied

    named = classes.join(tied, "node", "left").select("f", "g", "n", F.coalesce("component", "node").alias("component_id"))
    done = rows.select("doc_id", "n", "f", "g").join(stage(named, "join-named"), ["f", "g", "n"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: of the rows of the smallest id in its component, one.

    * rows without words: linked with nothing, all stay; repeats of a row: one stays
    * null ids: such rows are given ids of their own, after all others, so that they are linked by
      their texts too; a row that has an id stays rather than one that has none
    * an id with several texts: each row is a document of its own
    * columns of any name are kept as they are; no rows: no rows

    Rows are numbered, and only those that may be among the ones to go meet them in a join; the others stay in place.
    """
    # ids need not be unique or there at all: places in the order of ids are
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    numbered = stage(rows.withColumn("number", F.monotonically_increasing_id()), "join-numbered")
    found = stage(join(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))), "join-found")
    groups = stage(found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "join-groups")
    members = stage(found.join(groups, "component_id").select(F.col("doc_id").alias("number"), "component_id"), "join-members")
    among = value_filter(members, "number")(F.col("number"))
    named = members.join(numbered.where(among).select("number", F.col("row.doc_id").alias("id")), "number")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))["number"]
    gone = members.join(named.groupBy("component_id").agg(best.alias("number")), "number", "left_anti").select("number")
    gone = stage(gone, "join-gone")
    doubtful = value_filter(gone, "number")(F.col("number"))
    rest = numbered.where(doubtful).join(gone, "number", "left_anti").select("row")
    return numbered.where(~doubtful).select("row").unionByName(rest).select("row.*")
