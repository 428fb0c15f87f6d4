"""Ranked lexical search by hashed max-sketches.

A document's impact for a term grows with its count tf and falls with the document's
length, which is one number for all of its terms. So its sketch folds the counts: each
term has one of COORDINATES coordinates, the top bits of its hash, and a coordinate keeps
the greatest count that falls on it. Sketches need no corpus statistics and are never
rebuilt when texts are added; length and corpus come in when a query is answered.

A batch of sketches is turned into impacts once and looked up by all queries of a block:
the weighted sum over a query's coordinates is an upper bound of its score. A task
rescores, in descending order of the bound, from the exact counts stored beside the
sketch, and stops at the first bound below the score that is k-th best in it so far; what
is left out is beaten by k documents of the same task. So a task hands on at most k rows
a query, and the k best of those are the result, whole and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfit.llm.words import packed, sliced, words
from lexfit.session import stage

K = 10
COORDINATE_BITS = 12
#: Documents whose sketches are looked up together.
AT_ONCE = 512
#: Distinct terms of the queries that are answered in one scan; a block of queries is broadcast.
TERMS_A_BLOCK = 200_000
U = np.uint64


def document_vectors(found: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each document in ascending order, their counts, and where each document's terms end."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((found, owner))
    term, owner = found[order], owner[order]
    heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))[: len(term)])
    counts = np.diff(np.append(heads, len(term)))
    return term[heads], counts, np.searchsorted(owner[heads], np.arange(len(edges) - 1), "right")


def fold(terms: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, their greatest counts, and where each document's coordinates end."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    coordinate = (terms >> U(64 - COORDINATE_BITS)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, (coordinate[1:] != coordinate[:-1]) | (owner[1:] != owner[:-1]))[: len(terms)])
    most = np.maximum.reduceat(counts, heads) if len(heads) else counts
    return coordinate[heads], most, np.searchsorted(owner[heads], np.arange(len(ends)), "right")


def build_sketches(docs: DataFrame) -> DataFrame:
    """A staged row per row of ``docs`` (doc_id, text): doc_id, n (terms with repeats), and as little-endian binaries
    coordinates (uint16) and their maxima, terms (sorted uint64) and their counts (uint32)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 21):
            found, edges = words(batch.column("text"))
            terms, counts, ends = document_vectors(found, edges)
            coordinates, most, until = fold(terms, counts, ends)
            cols = [packed(coordinates.astype("<u2"), until), packed(most.astype("<u4"), until)]
            cols += [packed(terms.astype("<u8"), ends), packed(counts.astype("<u4"), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges)), *cols], ["doc_id", "n", "coordinates", "maxima", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, coordinates binary, maxima binary, terms binary, counts binary"
    return stage(docs.select("doc_id", "text").mapInArrow(build, schema), "search-sketches")


def query_terms(items: DataFrame) -> DataFrame:
    """A staged row per item that has a term: item_id and its distinct terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            terms, _, ends = document_vectors(*words(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(terms.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, terms array<long>").where(F.size("terms") > 0)
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "search-queries")


def values_of(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all binaries of a column, one after the other."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].view(kind)


def ends_of(column: pa.Array, width: int) -> np.ndarray:
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (edges[1:] - edges[0]) // width


class Queries:
    """A block of queries: all their terms in order with a weight each, and per query the numbers of its terms."""

    def __init__(self, lists: list[list[int]]) -> None:
        arrays = [np.array(x, np.int64).view(np.uint64) for x in lists]
        self.terms = np.unique(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint64)
        self.numbers = [np.searchsorted(self.terms, np.sort(a)) for a in arrays]
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        used, column = np.unique(self.terms >> U(64 - COORDINATE_BITS), return_inverse=True)
        self.column_of = np.full(1 << COORDINATE_BITS, -1, np.int64)
        self.column_of[used.astype(np.int64)] = np.arange(len(used))
        self.columns = [column[n] for n in self.numbers]
        self.n_columns = len(used)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def upper_bounds(own: Queries, coordinates: np.ndarray, most: np.ndarray, owner: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """For each query, a bound of its score in every document of the batch."""
    column = own.column_of[coordinates]
    used = column >= 0
    table = np.zeros((own.n_columns, len(m)), np.int64)
    table[column[used], owner[used]] = impacts(most[used], m[owner[used]])
    for numbers, columns in zip(own.numbers, own.columns, strict=True):
        yield own.weights[numbers] @ table[columns]


def exact(own: Queries, query: int, terms: np.ndarray, counts: np.ndarray, m: int) -> int:
    numbers = own.numbers[query]
    wanted = own.terms[numbers]
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    held = terms[at] == wanted
    return int(own.weights[numbers[held]] @ impacts(counts[at[held]], np.int64(m)))


class Best:
    """The k best (score, smaller id first) of each query; an id that is null comes after all others."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows = k, [[] for _ in range(n)]

    def threshold(self, query: int) -> int:
        """No score below this can be among the best; scores must be above 0."""
        rows = self.rows[query]
        return rows[-1][0] if len(rows) == self.k else 1

    def add(self, query: int, score: int, doc_id: object) -> None:
        rows = self.rows[query]
        rows.append((score, doc_id))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        del rows[self.k :]


def answer(sketches: DataFrame, lists: list[list[int]], statistics: tuple[int, int], k: int) -> DataFrame:
    """query (its number in ``lists``), doc_id and score: at most k rows a query from each task."""
    sc = sketches.sparkSession.sparkContext
    own = Queries(lists)
    terms = sc.broadcast(own.terms)
    kind = sketches.schema["doc_id"].dataType.simpleString()
    if not lists:
        return sketches.limit(0).select(F.lit(0).cast("long").alias("query"), "doc_id", F.lit(0).cast("long").alias("score"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            held = values_of(batch.column("terms"), "<u8")
            at = np.minimum(np.searchsorted(terms.value, held), len(sums) - 1)
            sums += np.bincount(at[terms.value[at] == held], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["number", "n"])

    df = np.zeros(len(own.terms), np.int64)
    for number, n in sketches.select("terms").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n")).collect():  # a row per term of the block
        df[number] = n
    terms.unpersist()
    n_docs, n_terms = statistics
    own.weigh(df, n_docs)
    shared = sc.broadcast(own)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(len(own.numbers), k)
        id_type = pa.null()
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                m = 10 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
                until, ends = ends_of(batch.column("coordinates"), 2), ends_of(batch.column("terms"), 8)
                owner = np.repeat(np.arange(len(m)), np.diff(until, prepend=0))
                coordinates, most = values_of(batch.column("coordinates"), "<u2"), values_of(batch.column("maxima"), "<u4")
                terms, counts = values_of(batch.column("terms"), "<u8"), values_of(batch.column("counts"), "<u4")
                begins, ids = np.append(0, ends[:-1]), batch.column("doc_id")
                for query, bounds in enumerate(upper_bounds(own, coordinates, most, owner, m)):
                    open_ = np.flatnonzero(bounds >= best.threshold(query))
                    for doc in open_[np.argsort(-bounds[open_], kind="stable")].tolist():
                        if bounds[doc] < best.threshold(query):
                            break
                        score = exact(own, query, terms[begins[doc] : ends[doc]], counts[begins[doc] : ends[doc]], m[doc])
                        if score >= best.threshold(query):
                            best.add(query, score, ids[doc].as_py())
        rows = [(query, doc_id, score) for query, found in enumerate(best.rows) for score, doc_id in found]
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), id_type, pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["query", "doc_id", "score"])

    return sketches.where("n > 0").mapInArrow(search, f"query long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each row of ``items`` (item_id, text).

    * null, empty or wordless texts: such a document is nowhere, such an item has no rows
    * equal scores: by ascending doc_id, null ids last; a repeated row of ``docs`` is another document
    * a repeated row of ``items`` is another query, ranked on its own
    * no documents or no items: no rows; texts of any length are read whole
    * other columns are not looked at; doc_id is a string or a whole number

    Queries are answered in blocks of about ``terms_a_block`` terms, a scan of the sketches each.
    """
    sketches = build_sketches(docs)
    n_docs, n_terms = sketches.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    queries = query_terms(items)
    total = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // terms_a_block))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about terms_a_block terms
        names = queries.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = answer(sketches, [r["terms"] for r in rows], (n_docs, max(n_terms, 1)), k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
