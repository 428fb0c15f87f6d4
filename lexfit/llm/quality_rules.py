"""Quality rules and a hashed n-gram log-likelihood ratio, both per whole text.

Two multinomials over hashed words and word pairs are counted: one over the trusted
documents, one over all documents. A document's score is the mean over its n-grams of
the log ratio of the two probabilities; it is kept if the base rules pass and the score
is not below a fixed threshold. Counting combines inside the tasks, so that a shuffle
sees at most two rows per bucket and task, whatever the corpus; scoring is a projection.
Trusted ids are never sent to the driver: a filter of fixed size finds the texts that may
be trusted, and only these move to meet the ids.

Built on DataFrame functions alone; no Python code runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.llm.common import WORD, let
from lexfit.session import stage

BUCKETS = 10_007
#: Added to each bucket's count in all documents; buckets times as many n-grams, shared out as in all
#: documents, are added to the trusted ones, so that few trusted documents say little and not that all are bad.
SMOOTHING = 1.0
#: The least mean log ratio of a kept document.
MIN_SCORE = -0.06
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Slots, as a power of two, that ids are hashed into to find the texts that may be trusted: 4 MB of bits, however many
#: ids. More ids than slots mean more texts to move, not other rows. One of Spark's bitmaps has 2**MAP_BITS of them.
SLOT_BITS = 25
MAP_BITS = 15
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACE, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(hashes: Column) -> Column:
    """Words inside a window of three words that the text has twice or more.

    A window's hash keeps its upper bits and carries its position in as many lower bits
    as the text's length needs; after a sort of those longs, repeats are neighbours.
    """
    n = F.size(hashes)
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    top = lambda x: F.call_function("shiftrightunsigned", x, bits)
    window = lambda h, i: F.call_function("shiftleft", top(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))), bits).bitwiseOR(i.cast("long"))
    packed = F.sort_array(F.transform(F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))), window))

    def repeated(p: Column) -> Column:
        again = F.filter(p, lambda x, j: top(x).eqNullSafe(top(F.get(p, j - 1))) | top(x).eqNullSafe(top(F.get(p, j + 1))))
        return F.sort_array(F.transform(again, lambda x: x.bitwiseAND(low)))

    def covered(places: Column) -> Column:
        three = F.lit(3).cast("long")
        new = F.transform(places, lambda p, k: F.coalesce(F.least(three, F.get(places, k + 1) - p), three))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(packed, repeated), covered)


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """A bucket for each word, and one for each pair of neighbours."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int")
    return F.concat(single, F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), pair))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none toxic."""
    by_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return by_id.where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << SLOT_BITS))


def slot_maps(ids: DataFrame) -> DataFrame:
    """The slots of all ``ids`` as bitmaps of 4 KB, one for each block of slots: a table of fixed size at most."""
    at = slot(F.col("doc_id"))
    slots = ids.select(F.shiftright(at, MAP_BITS).alias("_block"), at.bitwiseAND((1 << MAP_BITS) - 1).alias("_at"))
    return slots.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_map"))


def is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text and t, whether the id is among ``ids``, for every row of ``docs``; ``ids`` is staged, a row per id.

    A text whose slot no id has is surely not trusted and stays where it is. The others are
    joined to the ids by a sort-merge join, which holds no table in memory; the planner splits
    an id that many rows share.
    """
    rows = docs.select("doc_id", "text")
    # a join may cast ids of two types, but hashes of such ids differ
    if docs.schema["doc_id"].dataType == ids.schema["doc_id"].dataType:
        at = slot(F.col("doc_id"))
        rows = rows.withColumns({"_block": F.shiftright(at, MAP_BITS), "_at": at.bitwiseAND((1 << MAP_BITS) - 1)})
        rows = rows.join(F.broadcast(slot_maps(ids)), "_block", "left")
        may_be = F.col("doc_id").isNotNull() & F.coalesce(is_set(F.col("_map"), F.col("_at")), F.lit(False))
    else:
        may_be = F.col("doc_id").isNotNull()
    flag = ids.select("doc_id", F.lit(True).alias("_trusted")).hint("merge")  # else the planner may broadcast it
    met = rows.where(may_be).select("doc_id", "text").join(flag, "doc_id", "left")
    rest = rows.where(~may_be).select("text", F.lit(False).alias("t"))
    return rest.unionByName(met.select("text", F.coalesce("_trusted", F.lit(False)).alias("t")))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log ratio of each bucket, from all documents and all ``trusted`` ids; all 0 without trusted documents."""
    texts = marked(docs, stage(trusted.select("doc_id"), "trusted-ids"))
    # exploded where they are made: of a column the planner asks first, below the joins, whether it is empty
    grams = texts.select("t", F.explode(let(word_hashes(F.col("text")), lambda h: gram_buckets(h, buckets))).alias("b"))
    counts = grams.groupBy("b", "t").count().collect()  # at most two rows a bucket
    seen, raw = [0.0] * buckets, [SMOOTHING] * buckets
    for b, is_trusted, n in counts:
        raw[b] += n
        if is_trusted:
            seen[b] += n
    if not any(t for _, t, _ in counts):
        return [0.0] * buckets
    prior = SMOOTHING * buckets / math.fsum(raw)
    target = [t + prior * r for t, r in zip(seen, raw, strict=True)]
    shift = math.log(math.fsum(raw)) - math.log(math.fsum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def score(docs: DataFrame, ratios: list[float], min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    A row per row of ``docs``, of which only doc_id and text are read.

    * null or empty text, or one without words: all counts 0, llr 0, base_failed, not kept
    * null doc_id: scored like any other; repeated rows: a result each
    * a score equal to the threshold is kept
    * without trusted documents all ratios are 0, and the base rules alone decide
    """
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into a literal
    total = lambda h: F.aggregate(gram_buckets(h, len(ratios)), F.lit(0.0), lambda a, b: a + F.get(table, b))
    counted = lambda h: F.struct(F.size(h).cast("long").alias("n"), n_repeat_words(h).alias("again"), total(h).alias("total"))
    measured = docs.select("doc_id", "text", let(word_hashes(F.col("text")), counted).alias("_m")).select(
        "doc_id",
        F.col("_m.n").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        F.col("_m.again").alias("n_repeat_words"),
        (F.col("_m.total") / F.greatest(2 * F.col("_m.n") - 1, F.lit(1))).alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= min_score))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` and score ``docs``; see :func:`score`."""
    return score(docs, log_ratios(docs, trusted_ids(labels)))
