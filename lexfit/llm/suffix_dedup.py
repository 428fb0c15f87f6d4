"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every string of LENGTH bytes holds an anchor: the place whose hash of the next GRAM bytes
is least among those inside it. Equal strings have the same anchor, so two strings can be
equal only if their anchors' hashes are. Anchors are counted over the corpus; of those
whose hash occurs again, the strings with that anchor (a segment: they follow each
other) go to the shard of the hash. Segments equal in full need no sorting:
all their strings repeat. Of the rest one of each is kept, and a shard sorts the suffixes
of its segments by induction, takes their permuted common prefixes, and marks those that
share LENGTH bytes with one from another place.

A hash with more than GROUP_MAX different segments is not sorted in one task: its segments
are cut into parts that share a longer block, and these are dealt by that block. What is
still too many is cut again with blocks that leave out less, down to single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.llm import sketch
from lexfit.llm.common import grouped, let
from lexfit.llm.jaccard_join import BYTES, mix, powers
from lexfit.llm.suffix_array import PrefixHash, common_prefixes, suffix_array
from lexfit.session import stage

LENGTH = 400
GRAM = 100
SHARD_BYTES = 1 << 19
#: Blocks that stand for all strings of an anchor start at multiples of this before it.
BLOCK_STEP = 50
GROUP_MAX = 1_000
#: How far apart the strings of a part may start, each time that a group is too large.
STEPS = (50, 10, 1)
ID_BITS = 22
PLACE_BITS = 30

U = np.uint64


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def hashes_of(raw: np.ndarray) -> PrefixHash:
    up, down = powers(len(raw) + 1)
    return PrefixHash(BYTES[raw], up[: len(raw)], down)


def anchors(raw: np.ndarray, hashes: PrefixHash, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leftmost least gram of every string of ``length`` bytes; and where the strings of each begin and end."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 3
    places = np.arange(len(raw) - gram + 1)
    keyed = mix(hashes.of(places, gram)) >> U(PLACE_BITS) << U(PLACE_BITS) | places.astype(np.uint64)
    width = length - gram + 1
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    grid = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(grid, 1).reshape(-1)
    since = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = np.arange(len(raw) - length + 1)
    least = (np.minimum(since[starts], upto[starts + width - 1]) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(least, prepend=-1))  # the strings of one anchor follow each other
    return least[first], first, np.append(first[1:], len(least)) - 1 + length


def content_key() -> list[Column]:
    """Two hashes of the text: documents of equal content need the same removals."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("f"), F.xxhash64(text, F.lit(1)).alias("g")]


def all_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """f, g, start and size of the segment, the anchor's place in it, its hash and the segment's hash, for every anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches):
            f, g = batch.column("f").to_numpy(), batch.column("g").to_numpy()
            parts: list[tuple] = []
            for row, text in enumerate(texts):
                raw = text_bytes(text)
                if len(raw) < length:
                    continue
                hashes = hashes_of(raw)
                at, low, high = anchors(raw, hashes, length, gram)
                seg = mix(hashes.of(low, high - low) + (high - low).astype(np.uint64))
                parts.append((np.full(len(at), f[row]), np.full(len(at), g[row]), low, high - low, at - low, mix(hashes.of(at, gram)).view(np.int64), seg.view(np.int64)))
            if parts:
                cols = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["f", "g", "start", "size", "lead", "anchor", "segment"])

    return docs.mapInArrow(cut, "f long, g long, start long, size long, lead long, anchor long, segment long")


def may_repeat(groups: np.ndarray, segments: list[bytes], leads: np.ndarray, length: int, gram: int) -> np.ndarray:
    """False for segments of which no string can occur in another segment of the same group.

    A string that starts between two multiples of the step before the anchor holds the
    block of ``length - step`` bytes from the nearer one; so one of a few blocks must be
    in another segment, at the same distance from the anchor.
    """
    sizes = np.array([len(x) for x in segments])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    hashes = hashes_of(np.frombuffer(b"".join(segments), np.uint8))
    step = min(BLOCK_STEP, max(1, length - gram))
    keep = np.zeros(len(segments), bool)
    for before in range(0, length - gram + 1, step):
        inside = np.flatnonzero((leads >= before) & (leads - before + length - step <= sizes))
        block = mix(hashes.of(starts[inside] + leads[inside] - before, length - step)) ^ groups[inside].view(np.uint64)
        _, which, times = np.unique(block, return_inverse=True, return_counts=True)
        keep[inside[times[which] > 1]] = True
    return keep


def repeated_starts(segments: list[bytes], places: np.ndarray, sure: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its offsets start a string that also starts at another place.

    ``places`` has a number for the first byte of each segment, such that equal numbers
    (plus offsets) are the same place; ``sure`` marks segments known to occur elsewhere.
    """
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text = np.append(raw.astype(np.int64) + 2, 0)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]).astype(np.int64)
    owner = np.append(np.repeat(np.arange(len(segments)), sizes + 1), len(segments) - 1)
    offset = np.arange(len(text)) - starts[owner]
    room = np.maximum(sizes[owner] - offset, 0)
    text[starts + sizes] = 1
    up, down = powers(len(text) + 1)
    hashes = PrefixHash(mix(text.astype(np.uint64) + U(1)), up[: len(text)], down)
    sa = suffix_array(text, 258, hashes)
    long = common_prefixes(text, sa, hashes, room)[sa] >= length
    heads = np.flatnonzero(~long)
    place = places[owner[sa]] + offset[sa]
    several = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    several |= np.maximum.reduceat(sure[owner[sa]].astype(np.int8), heads) > 0
    marked = np.zeros(len(text), bool)
    marked[sa] = np.repeat(several, np.diff(np.append(heads, len(sa))))
    marked &= room >= length
    return [marked[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX) -> DataFrame:
    """f, g, start and end of repeated stretches; they may overlap."""
    keyed = docs.select("text", *content_key())
    found = stage(all_anchors(keyed, length, gram), "dedup-anchors")
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high")).where("n > 1")
    shared = stage(shared.select("anchor", (F.col("low") != F.col("high")).alias("differ")), "dedup-shared")
    again = stage(found.join(shared, "anchor"), "dedup-again")
    kinds = again.groupBy("anchor", "segment").agg(F.count("*").alias("n"))
    equal = stage(kinds.where("n > 1").select("anchor", "segment"), "dedup-equal")
    whole = again.join(equal, ["anchor", "segment"], "left_semi")
    whole = whole.select("f", "g", "start", (F.col("start") + F.col("size")).alias("end")).distinct()

    one = F.min(F.struct("f", "g", "start", "size", "lead")).alias("at")
    needed = again.where("differ").groupBy("anchor", "segment").agg(one, (F.count("*") > 1).alias("sure"))
    needed = stage(needed.select("anchor", "sure", "at.*"), "dedup-needed")
    texts = keyed.where(sketch.membership(needed.select("f").distinct(), ID_BITS)(F.col("f"))).groupBy("f", "g").agg(F.any_value("text").alias("text"))
    lists = needed.groupBy("f", "g").agg(F.collect_list(F.struct("anchor", "sure", "start", "size", "lead")).alias("segments"))
    part = lambda raw, s: F.struct(s["anchor"], s["sure"], s["start"], s["lead"], F.substring(raw, s["start"].cast("int") + 1, s["size"].cast("int")).alias("bytes"))
    parts = let(F.col("text").cast("binary"), lambda raw: F.transform("segments", lambda s: part(raw, s)))
    cut = stage(lists.join(texts, ["f", "g"]).select("f", "g", F.explode(parts).alias("part")).select("f", "g", "part.*"), "dedup-segments")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and weight >= SHARD_BYTES:
                    yield from sorted_shard(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[6])
                last = row[0]
        if held:
            yield from sorted_shard(held)

    def sorted_shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        may = may_repeat(np.array([r[0] for r in held]), [r[6] for r in held], np.array([r[5] for r in held]), length, gram)
        held = [r for r, m in zip(held, may, strict=True) if m]
        if not held:
            return
        documents = {key: k for k, key in enumerate(dict.fromkeys((r[2], r[3]) for r in held))}
        places = np.array([(documents[r[2], r[3]] << 40) + r[4] for r in held])
        marks = repeated_starts([r[6] for r in held], places, np.array([r[1] for r in held]), length)
        out = [(r[2], r[3], r[4] + a, r[4] + b - 1 + length) for r, m in zip(held, marks, strict=True) if not r[1] for a, b in runs(m)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["f", "g", "start", "end"])

    out = [whole]
    for step in [min(step, max(1, (length - gram) // 2)) for step in STEPS]:
        large = stage(cut.groupBy("anchor").count().where(F.col("count") > group_max).select("anchor"), "dedup-large")
        none = large.isEmpty()
        small = (cut if none else cut.join(large, "anchor", "left_anti")).select("anchor", "sure", "f", "g", "start", "lead", "bytes")
        out.append(small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shard, "f long, g long, start long, end long"))
        if none:
            break
        equal_parts, cut = parted(cut.join(large, "anchor", "left_semi"), length, step)
        out.append(equal_parts)
    return reduce(DataFrame.unionByName, out)


def parted(segments: DataFrame, length: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the parts of segments that are equal in full, and one of each of the parts that are not alone.

    A part holds the strings that start less than ``step`` apart, counted from the anchor;
    they share a block of ``length - step + 1`` bytes, which is the anchor of the part. With
    a step of 1 the parts of an anchor are equal, so none is left.
    """
    share = length - step + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for anchor, sure, f, g, start, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sure", "f", "g", "start", "lead", "bytes")), strict=True):
                hashes = hashes_of(np.frombuffer(raw, np.uint8))
                least = lead - (len(raw) - length)
                block = np.arange(least // step * step, lead + 1, step)
                low, high = np.maximum(block, least), np.minimum(block + step - 1, lead)
                size = high - low + length
                key = mix(hashes.of(lead - block, share) + block.astype(np.uint64)).view(np.int64) ^ anchor
                whole = mix(hashes.of(lead - high, size) + size.astype(np.uint64)).view(np.int64)
                for k, w, at, n, far in zip(key.tolist(), whole.tolist(), (lead - high).tolist(), size.tolist(), (high - block).tolist(), strict=True):
                    rows.append((k, w, sure, f, g, start + at, far, raw[at : at + n]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "segment", "sure", "f", "g", "start", "lead", "bytes"])

    schema = "anchor long, segment long, sure boolean, f long, g long, start long, lead long, bytes binary"
    parts = stage(segments.mapInArrow(cut, schema), "dedup-parts")
    one = F.min(F.struct("f", "g", "start", "lead", "bytes")).alias("at")
    kinds = stage(parts.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.max("sure").alias("sure"), one), "dedup-kinds")
    equal = parts.where("not sure").join(kinds.where("n > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    several = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
    left = kinds.join(several, "anchor", "left_semi").select("anchor", (F.col("sure") | (F.col("n") > 1)).alias("sure"), "at.*")
    return equal.select("f", "g", "start", (F.col("start") + F.octet_length("bytes")).alias("end")), stage(left, "dedup-segments")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row of ``docs`` (doc_id, text).

    * null text: empty; texts shorter than ``length`` bytes lose nothing; long ones are read whole
    * null doc_id: like any other row; repeated rows and equal texts count as other places, so both lose all
    * strings are judged on the input; no rows: no rows
    """
    docs = docs.select("doc_id", "text")
    found = spans(docs, length, gram, group_max).distinct()
    lists = stage(found.groupBy("f", "g").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "dedup-spans")
    keyed = docs.select("doc_id", "text", *content_key())
    keyed = keyed.withColumn("_in", sketch.membership(lists.select("f"), ID_BITS)(F.col("f")))
    hit = keyed.where("_in").join(lists, ["f", "g"], "left").select("doc_id", "text", "spans")
    rest = keyed.where("not _in").select("doc_id", "text", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches):
            rows = []
            for text, own in zip(texts, batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                gone = merged([(s["start"], s["end"]) for s in own or ()])
                edges = [0, *(x for ab in gone for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return hit.unionByName(rest).mapInArrow(finish, schema)
