"""Hierarchical best-fit packing of token pieces into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions
of a bounded number of rows, each of which packs its own by best fit, longest first.
Bins that are nearly full are done; the others, as single items, go on to a round of
fewer partitions, and so on up a tree. A bin that not even the smallest item left
anywhere would fit into is done as well, so rounds carry only what can still combine.
No task holds more than about ``rows_per_task`` items, also at the root: if that many
are left and a round hardly merges any, their bins stand.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfit.llm.common import grouped, kept
from lexfit.session import stage

CAPACITY = 2048
ROWS_PER_TASK = 100_000
FAN_IN = 8
#: A bin with no more room than this is done.
NEARLY_FULL = 8
CACHE_WORDS = 600_000
#: Words that go to the tokenizer in one call: what it makes of a call takes some hundred bytes a token.
LEARN_WORDS = 4096
TAIL = b".,;:!?*&%$#|"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a cache of words.

    The vocabulary never joins tokens across white space, so a text's ids are those of its
    words in turn. Words seen for the first time are encoded together, LEARN_WORDS a call; a
    word of letters and a tail of marks is two pieces to the tokenizer and is kept as such.
    The cache is emptied when it is full; what it holds doesn't change any result.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def part(self, text: bytes) -> bytes:
        if (ids := self.parts.get(text)) is None:
            ids = self.parts[text] = self.whole(text)
        return ids

    def learn(self, words: set[bytes]) -> None:
        split, parts = [], self.parts
        for word in words:
            core = word.rstrip(TAIL)
            if core.isalpha():  # of bytes: ASCII letters alone
                split.append((word, core.lower(), word[len(core) :]))
            elif (plain := core.decode()).isalpha() and max(plain) < "ƀ":
                split.append((word, plain.lower().encode(), word[len(core) :]))
            else:
                self.cache[word] = self.whole(word)
        new = list({core for _, core, _ in split if core not in parts})
        for first in range(0, len(new), LEARN_WORDS):
            some = new[first : first + LEARN_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, at = ids.tobytes(), (4 * stops).tolist()
                parts.update(zip(some, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
        for word, core, tail in split:
            ids = parts.get(core) or self.part(core)
            self.cache[word] = ids + (parts.get(tail) or self.part(tail)) if tail else ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [(text or "").encode("utf-8", "replace").split() for text in texts]
        words = set().union(*split)
        missing = {w for w in words if w not in self.cache}
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache, self.parts, missing = {}, {}, words
        self.learn(missing)
        for part in split:
            yield b"".join(map(self.cache.__getitem__, part))


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, which serves all its tasks until one of another kind comes."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for.

    A document's ids end with one id 0; null or empty text is that id alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch, texts in grouped(batches, keep=f"encoder {tokenizer}"):
            rows, cols = [], ([], [], [], [], [])
            for row, ids in enumerate(encoder.encode(texts)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append(row)
                    for col, value in zip(cols, (k, at, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(made[: 5 + with_ids], names[: 5 + with_ids])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin of each item and its offset there. Ties go to the item that comes first."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0  # bit r of the mask: some bin has room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fit := mask >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            mask |= 1 << left
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``items`` (any columns, with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    Every item is in one sequence; offsets in a sequence run from 0 without gaps. Repeated
    rows are items of their own, and no rows give no rows.
    """
    columns = items.columns

    # numbered by Spark: the task that makes the items has a Python worker already, and a second one takes memory
    number = F.monotonically_increasing_id()
    own = F.shiftleft(F.shiftright(number, 33), 34) + number.bitwiseAND(F.lit((1 << 33) - 1))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema = f"{fields}, _bin long, _offset long"
    open_rows = stage(items.select("*", own.alias("_bin"), F.lit(0).cast("long").alias("_offset")), "pack-items")
    count = open_rows.count()
    tasks, level, done = max(1, -(-count // rows_per_task)), 0, []
    while count:
        level += 1

        def merge(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            rows = pa.Table.from_batches(got)
            _, inverse = np.unique(rows["_bin"].to_numpy(), return_inverse=True)
            lengths = rows["length"].to_numpy()
            sizes = np.bincount(inverse, lengths).astype(np.int64)
            bins, offsets = best_fit(sizes, capacity)
            full = np.bincount(bins, sizes).astype(np.int64)[bins[inverse]]
            first = (level << 58) + (TaskContext.get().partitionId() << 34)
            new = {"_bin": first + bins[inverse], "_offset": rows["_offset"].to_numpy() + offsets[inverse], "_size": full}
            yield from rows.select(columns).append_column("_bin", pa.array(new["_bin"])).append_column("_offset", pa.array(new["_offset"])).append_column("_size", pa.array(new["_size"])).combine_chunks().to_batches(max_chunksize=65536)

        merged = stage(open_rows.select(*columns, "_bin", "_offset").repartition(tasks, "_bin").mapInArrow(merge, f"{schema}, _size long"), "pack-round")
        room = capacity - F.col("_size")
        left = merged.where(room > NEARLY_FULL)
        least, bins = left.agg(F.min("_size"), F.count(F.when(F.col("_offset") == 0, 1))).first()
        last = tasks == 1 or not bins or (level > 1 and bins > 0.99 * count)
        if last:
            done.append(merged)
            break
        can_grow = (room > NEARLY_FULL) & (room >= least)
        done.append(merged.where(~can_grow))
        open_rows = merged.where(can_grow)
        count = open_rows.where("_offset = 0").count()
        tasks = max(1, -(-tasks // FAN_IN), -(-count // rows_per_task))
    packed = reduce(DataFrame.unionByName, done) if done else open_rows
    return packed.select(*columns, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))


def apply(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all ``docs`` (doc_id, text; other columns are ignored): a row per piece.

    Null and empty texts are one piece of one token; a null doc_id stays null; repeated
    rows are packed each; texts of any length are cut into pieces and never shortened.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
