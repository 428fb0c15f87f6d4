"""Hashes of all words of a batch of texts, taken from Arrow's buffers without making strings.

A word is a run of digits, ASCII letters and characters beyond ASCII; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexfit.llm.jaccard_join import BYTES, mix, powers

U = np.uint64
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x41:0x5B] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
LOWER = np.arange(256)
LOWER[0x41:0x5B] += 0x20
LOWERED = BYTES[LOWER]
#: Running sums of hashes start anew after about so many bytes, so that they stay small whatever a text's length.
PIECE = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes of text, or of one row that has more."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words start among them (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    inside = IN_WORD[raw]
    between = edges[(edges > 0) & (edges < len(raw))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[between] = inside[between]
    last[between - 1] = inside[between - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = raw[base : ends[upto - 1]]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(LOWERED[part] * up, out=total[1:])
        a, b = starts[at:upto] - base, ends[at:upto] - base
        found[at:upto] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return found, np.searchsorted(starts, edges)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary for each entry of ``ends``: the bytes of ``values`` up to there, from the entry before."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], ends * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
