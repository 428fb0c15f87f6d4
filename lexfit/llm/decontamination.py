"""Benchmark decontamination by a distributed positional inverted index.

The training texts are indexed in blocks of about BLOCK_BYTES. A block is one row: its
documents, a sorted dictionary of its terms (64-bit hashes) with their counts, and the
posting lists, each the ascending places of a term. Places number the words of a block;
one is left out between documents, so no run of places crosses two of them. The index is
built in one narrow pass, and a block needs no other block to be searched.

Benchmark items are cut into windows of words. How often their terms occur in the whole
index is summed from the dictionaries alone. A window is then sought in a block only if
all its terms are in the dictionary: the list of its rarest term, less its offset in the
window, gives the possible starts; of those the other lists, each less its own offset,
keep what they hold too, the next rarest first. What is left are the exact phrases. With
``within``, stretches of that many words that hold all terms in any order are found
likewise, from the rarest term outwards.

Windows are taken to the blocks in rounds of at most WINDOWS_A_ROUND, so what is
broadcast is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.llm.words import packed, sliced, words
from lexfit.session import stage

WINDOW = 10
BLOCK_BYTES = 8 << 20
WINDOWS_A_ROUND = 100_000
#: Possible starts that are held at once while lists are intersected.
STARTS_AT_ONCE = 1 << 21
SHIFT = 32

HITS = "starts array<long>, ends array<long>"


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The staged index of ``docs`` (doc_id, text): a row per block.

    Columns: block, doc_ids, n_words (a number per document), and as little-endian
    binaries terms (sorted uint64), counts and places (uint32).
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch in sliced(batches, block_bytes):
            found, edges = words(batch.column("text"))
            n_words = np.diff(edges)
            places = np.arange(len(found)) + np.repeat(np.arange(len(n_words)), n_words)
            order = np.argsort(found, kind="stable")
            ranked = found[order]
            heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
            counts = np.diff(np.append(heads, len(ranked)))
            one = lambda values: pa.array([values.tobytes()], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            cols = [pa.array([block], pa.int64()), ids, pa.array([n_words.tolist()], pa.list_(pa.int64()))]
            cols += [one(ranked[heads].astype("<u8")), one(counts.astype("<u4")), one(places[order].astype("<u4"))]
            block += 1
            yield pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "n_words", "terms", "counts", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_ids array<{kind}>, n_words array<long>, terms binary, counts binary, places binary"
    return stage(docs.select("doc_id", "text").mapInArrow(index, schema), "decon-index")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and terms of every ``size`` consecutive words of an item, or of all if it has fewer but some; staged."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            found, edges = words(batch.column("text"))
            n_words = np.diff(edges)
            n = np.where(n_words > size, n_words - size + 1, np.minimum(n_words, 1))
            owner = np.repeat(np.arange(len(n)), n)
            start = edges[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(n_words[owner], size)
            offsets = np.concatenate([[0], np.cumsum(length)])
            at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
            terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), terms], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, terms array<long>")
    return stage(rows.distinct(), "decon-windows")


class Windows:
    """The windows of a round: their terms as numbers of a sorted list of distinct terms, and the items that have them."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        terms = rows.column("terms").combine_chunks()
        lengths = np.diff(terms.offsets.to_numpy())
        values = terms.flatten().to_numpy().view(np.uint64)
        self.terms, number = np.unique(values, return_inverse=True)
        grid = np.full((len(lengths), size), -1, np.int64)
        grid[np.arange(size) < lengths[:, None]] = number
        self.grid, which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.lengths = (self.grid >= 0).sum(1)
        ids = rows.column("item_id").combine_chunks().dictionary_encode("encode")
        self.item_ids = ids.dictionary
        order = np.argsort(which, kind="stable")
        self.owners, self.first = ids.indices.to_numpy()[order], np.searchsorted(which[order], np.arange(len(self.grid) + 1))

    def rank(self, often: np.ndarray) -> None:
        """Orders the offsets of each window, the rarest term first; unused ones last."""
        self.often = often
        self.order = np.argsort(np.where(self.grid >= 0, often[self.grid], np.iinfo(np.int64).max), axis=1, kind="stable")

    def items(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in ``item_ids`` of the windows' items, and for each which of the windows given it belongs to."""
        n = self.first[which + 1] - self.first[which]
        of = np.repeat(np.arange(len(which)), n)
        at = self.first[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return self.owners[at], of


class Lists:
    """The posting lists of a block for the terms of a round, each entry as term number and place in one sorted array."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
        self.held = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
        at = np.flatnonzero(self.held), at[self.held]
        starts = np.where(at[1] > 0, ends[at[1] - 1], 0) if len(ends) else at[1]
        n = ends[at[1]] - starts if len(ends) else at[1]
        self.counts = np.zeros(len(wanted), np.int64)
        self.counts[at[0]] = n
        self.first = np.cumsum(self.counts) - self.counts
        total = int(self.counts.sum())
        source = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(total)
        self.keys = np.repeat(at[0] << SHIFT, n) + places[source]

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = (term << SHIFT) + place
        at = np.searchsorted(self.keys, want)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the term from ``place`` on, or a number beyond all places."""
        at = np.searchsorted(self.keys, (term << SHIFT) + place)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        ok = (at < len(self.keys)) & (found >> SHIFT == term)
        return np.where(ok, found & ((1 << SHIFT) - 1), 1 << SHIFT)


def rarest(windows: Windows, lists: Lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and the places of their rarest terms, for windows of which the block holds all terms; in slices."""
    whole = np.flatnonzero((lists.held[windows.grid] | (windows.grid < 0)).all(1))
    terms = windows.grid[whole, windows.order[whole, 0]]
    sizes = np.cumsum(lists.counts[terms])
    at = 0
    while at < len(whole):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + STARTS_AT_ONCE, "right")))
        n = lists.counts[terms[at:end]]
        which = np.repeat(np.arange(at, end), n)
        place = np.repeat(lists.first[terms[at:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield whole[which], lists.keys[place] & ((1 << SHIFT) - 1)
        at = end


def phrases(windows: Windows, lists: Lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and the places where they start as phrases."""
    for which, place in rarest(windows, lists):
        start = place - windows.order[which, 0]
        which, start = which[start >= 0], start[start >= 0]
        for k in range(1, windows.grid.shape[1]):
            if not len(which):
                break
            offset = windows.order[which, k]
            term = windows.grid[which, offset]
            ok = term < 0
            ok[~ok] = lists.holds(term[~ok], start[~ok] + offset[~ok])
            which, start = which[ok], start[ok]
        yield which, start


def near(windows: Windows, lists: Lists, limits: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window numbers, first and last place of the shortest stretch of at most ``within`` places, from each start on,
    that holds all terms of a window and its rarest term at a given place; ``limits``: where documents end."""
    for which, place in rarest(windows, lists):
        low = np.append(0, limits)[np.searchsorted(limits, place, "right")]
        for back in range(within):
            start = place - back
            ok = start >= low
            w, a = which[ok], start[ok]
            begins, last = np.zeros(len(w), bool), place[ok].copy()
            for k in range(windows.grid.shape[1]):
                term = windows.grid[w, windows.order[w, k]]
                used = term >= 0
                found = np.where(used, lists.next(np.maximum(term, 0), a), last)
                begins |= used & (found == a)
                last = np.maximum(last, found)
                keep = last < np.minimum(a + within, limits[np.searchsorted(limits, a, "right")]) if len(a) else used
                w, a, last, begins = w[keep], a[keep], last[keep], begins[keep]
            yield w[begins], a[begins], last[begins]


def runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches joined; ends are exclusive."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > upto[:-1])[: len(first)]
    return first[new], upto[np.append(new[1:], True)[: len(first)]] if len(first) else upto


def lists_by(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """``values`` as one list per owner 0..n-1, in order."""
    order = np.argsort(owner, kind="stable")
    offsets = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order)))


def one_round(index: DataFrame, windows: Windows, within: int | None, all_documents: bool) -> DataFrame:
    sc = index.sparkSession.sparkContext
    terms = sc.broadcast(windows.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for held, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                held, counts = np.frombuffer(held.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(held, terms.value), max(len(held) - 1, 0))
                if len(held):
                    sums += np.where(held[at] == terms.value, counts[at], 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["number", "n"])

    often = np.zeros(len(windows.terms), np.int64)
    totals = index.select("terms", "counts").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n"))
    for number, n in totals.collect():  # a row per term of the round
        often[number] = n
    terms.unpersist()
    windows.rank(often)
    shared = sc.broadcast(windows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_words = batch.column("doc_ids")[row].values, batch.column("n_words")[row].values.to_numpy()
                held, counts, places = (np.frombuffer(batch.column(c)[row].as_buffer(), k) for c, k in (("terms", "<u8"), ("counts", "<u4"), ("places", "<u4")))
                lists = Lists(held, np.cumsum(counts.astype(np.int64)), places.astype(np.int64), own.terms)
                limits = np.cumsum(n_words + 1)
                found = [(np.zeros(0, np.int64),) * 2, *phrases(own, lists)]
                which, start = (np.concatenate(x) for x in zip(*found, strict=True))
                first, upto = runs(start, start + own.lengths[which])
                hit_doc, doc = np.searchsorted(limits, first, "right"), np.searchsorted(limits, start, "right")
                begin = np.append(0, limits)[hit_doc]
                cols = [lists_by(hit_doc, pa.array(x - begin), len(ids)) for x in (first, upto)]
                cols.append(items_by(own, doc, which, len(ids)))
                if within:
                    close = [(np.zeros(0, np.int64),) * 2, *((w, np.searchsorted(limits, a, "right")) for w, a, _ in near(own, lists, limits, within))]
                    which, doc = (np.concatenate(x) for x in zip(*close, strict=True))
                else:
                    which, doc = which[:0], doc[:0]
                cols.append(items_by(own, doc, which, len(ids)))
                block = pa.array(np.full(len(ids), batch.column("block")[row].as_py()), pa.int64())
                out = pa.RecordBatch.from_arrays([block, pa.array(np.arange(len(ids))), ids, pa.array(n_words), *cols], ["block", "place", "doc_id", "n_words", "starts", "ends", "items", "near_items"])
                yield out if all_documents else out.filter(pa.array(np.diff(cols[2].offsets) + np.diff(cols[3].offsets) > 0))

    def items_by(own: Windows, doc: np.ndarray, which: np.ndarray, n: int) -> pa.ListArray:
        pairs = np.unique(doc * max(len(own.grid), 1) + which)
        doc, which = np.divmod(pairs, max(len(own.grid), 1))
        item, of = own.items(which)
        pairs = np.unique(doc[of] * max(len(own.item_ids), 1) + item)
        doc, item = np.divmod(pairs, max(len(own.item_ids), 1))
        return lists_by(doc, own.item_ids.take(pa.array(item)), n)

    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    item = windows.item_kind
    return index.mapInArrow(search, f"block long, place long, doc_id {kind}, n_words long, {HITS}, items array<{item}>, near_items array<{item}>")


def find(index: DataFrame, items: DataFrame, size: int = WINDOW, within: int | None = None, windows_a_round: int = WINDOWS_A_ROUND) -> DataFrame:
    """What of ``items`` (item_id, text) occurs in the documents of a staged index.

    A row per document: doc_id, n_words, starts and ends of the stretches of words inside
    a phrase (word numbers, end exclusive; stretches of different rounds may overlap),
    items (distinct ids of items with a phrase here) and near_items (ids of items of which
    all terms of a window stand within ``within`` words; empty unless that is given).
    """
    windows = item_windows(items, size)
    rounds = max(1, -(-windows.count() // windows_a_round))
    parts = None
    for k in range(rounds):
        rows = windows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == k).toArrow()  # about windows_a_round rows
        one = Windows(rows, size)
        one.item_kind = items.schema["item_id"].dataType.simpleString()
        part = one_round(index, one, within, k == 0)
        parts = part if parts is None else parts.unionByName(part)
    if rounds > 1:
        flat = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "near_items")}
        parts = parts.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *flat.values())
    distinct = [F.array_distinct(c).alias(c) for c in ("items", "near_items")]
    return parts.select("doc_id", "n_words", "starts", "ends", *distinct)


def covered(starts: Column, ends: Column) -> Column:
    """Number of words inside any of the stretches."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(state: Column, run: Column) -> Column:
        upto = F.greatest(state["upto"], run["ends"])
        return F.struct((state["n"] + upto - F.greatest(state["upto"], F.least(run["starts"], upto))).alias("n"), upto.alias("upto"))

    return F.aggregate(F.array_sort(F.arrays_zip(starts.alias("starts"), ends.alias("ends"))), zero, add)["n"]


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, windows_a_round: int = WINDOWS_A_ROUND) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``.

    * null, empty or wordless text: no words, nothing hit; a null or wordless item has no window
    * null doc_id: a row like any other; repeated rows: a result each
    * repeated item ids count once; an item without an id counts in n_hit and, once, in n_items, not in the digest
    * no documents: no rows; no items: nothing is hit; texts of any length are read whole
    * columns other than doc_id, text and item_id are not looked at
    """
    found = find(build_index(docs), items, size, windows_a_round=windows_a_round)
    n_hit = covered(F.col("starts"), F.col("ends"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)
