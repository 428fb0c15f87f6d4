"""Counts of 64-bit hashes in a fixed number of slots, summed over the whole corpus.

A sketch has a fixed size whatever is counted, so it may be collected and broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.llm.common import forget

BLOCK_BITS = 16


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many of the hashes (uint64) that ``hashes_of`` yields for all batches fall into each of 2**bits slots.

    Counts end at 2**32 - 1. A task's counts travel compressed, in blocks; each block is summed apart.
    """
    blocks, width = 1 << max(bits - BLOCK_BITS, 0), 1 << min(bits, BLOCK_BITS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mine, seen = np.zeros(blocks * width, np.uint32), False
        for batch in batches:
            for hashes in hashes_of(batch):
                at, n = np.unique(slots(hashes, bits), return_counts=True)
                mine[at] += np.minimum(n, 2**32 - 1 - mine[at]).astype(np.uint32)
                seen = True
        if seen:
            parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in mine.reshape(blocks, width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
                sums[block] = sums.get(block, 0) + part
        if sums:
            parts = [zlib.compress(np.minimum(p, 2**32 - 1).astype("<u4").tobytes(), 1) for p in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    rows = df.mapInArrow(local, schema).repartition(blocks, "block").mapInArrow(combine, schema).collect()  # 2**bits counters
    total = np.zeros((blocks, width), np.uint32)
    for block, raw in rows:
        total[block] = np.frombuffer(zlib.decompress(raw), "<u4")
    return total.reshape(-1)


def flags(keys: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags, packed: set for the slots of all long hashes in ``keys`` (one column)."""

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(np.uint64)

    return np.packbits(count(keys, hashed, bits) > 0)


def holds(packed: np.ndarray, hashes: pa.Array, bits: int) -> np.ndarray:
    """False for hashes surely not among those of ``flags``, true for those and a few others."""
    at = slots(hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits)
    return (packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def membership(keys: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test for long hashes: false surely not in ``keys`` (one long column), true in it or one of a few others.

    Its size is 2**bits flags, so a large table can be cut down in place before it is joined.
    """
    shared = keys.sparkSession.sparkContext.broadcast(flags(keys, bits))

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, hashes, bits))

    return held
