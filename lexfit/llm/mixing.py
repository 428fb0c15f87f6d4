"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit key, a hash of its id. A source whose budget is q whole
copies and a rest takes q copies of each document and one more of those whose key lies
below a threshold; thresholds of larger budgets include those of smaller ones. The
threshold is found by histograms: sizes summed by source and the next ten bits of the
key, of which only the bucket that the budget falls into is refined. Nothing is sorted
but the at most 1024 buckets of a source, and only sums leave a task.

Built on DataFrame functions alone; no Python code runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfit.llm.common import lookup, word_count
from lexfit.session import stage

KEY_BITS = 60
LEVEL_BITS = 10
MAX_REPEAT = 3


def mixing_key(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text; a null id has the key of ''."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``: 0, 1, 2 ... in code point order, null last.

    The sort is by ranges; places count within a range, and the ranges' sizes are summed.
    """
    ordered = stage(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-order"
    )
    sizes = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("_inside", inside).join(before, "_range").withColumn("place", F.col("_before") + F.col("_inside") - 1).drop("_range", "_inside", "_before")


def with_targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to a staged table of source, source_size and weight.

    The total is shared by weight; a source stops at ``max_repeat`` times its size, and
    what is over is shared again by weight among the others until none is above. Each
    pass is one aggregate of three numbers; a pass caps at least one source or is the last.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_repeat
    left, weights, capped_weight = total, None, -1
    while True:
        if weights is None:
            is_capped = F.lit(False)
        else:
            is_capped = cap * F.lit(weights).cast("decimal(38,0)") <= F.lit(left).cast("decimal(38,0)") * F.col("weight")
        got = sources.agg(
            F.coalesce(F.sum(F.when(is_capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(is_capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0)),
        ).first()
        if got[1] == capped_weight:
            break
        capped_weight, left, weights = got[1], total - got[0], got[2]
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(max(weights, 1)))
    return sources.withColumn("target", F.when(is_capped, cap.cast("double")).otherwise(share))


def named(docs: DataFrame) -> DataFrame:
    """Adds a key for the source that is never null, and the mixing key."""
    return docs.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit("")), "_key": mixing_key(F.col("doc_id"))})


NAME = ["_null", "_name"]


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: source_size, target, whole copies and the threshold for one more; ``sized`` is staged."""
    sums = sized.groupBy(*NAME, "source").agg(F.sum("size").alias("source_size"))
    places = stage(ranked(sums), "mix-places")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    goals = with_targets(stage(places.withColumn("weight", weight.cast("long")), "mix-sources"), max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = stage(goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")

    state = goals.where("source_size > 0").select(*NAME, "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    thresholds, inside, shift = [], sized, KEY_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        buckets = (
            inside.groupBy(*NAME, F.shiftright("_key", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        )
        running = Window.partitionBy(*NAME).orderBy("bucket")
        edge = stage(
            buckets.join(state.drop("prefix"), NAME)
            .withColumn("upto", F.col("below") + F.sum("n").over(running))
            .where("upto > rest and upto - n <= rest")
            .withColumn("below", F.col("upto") - F.col("n")),
            "mix-edge",
        )
        done = F.col("low") == F.col("high")
        extra = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("below"))
        thresholds.append(edge.where(done).select(*NAME, (F.col("low") + extra.cast("long")).alias("threshold")))
        state = edge.where(~done).select(*NAME, "rest", "below", F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
        refined = stage(state.select(*NAME, "prefix"), "mix-refine")
        inside = lookup(inside.withColumn("prefix", F.shiftright("_key", shift)), refined, [*NAME, "prefix"], spread=["_key"]).drop("prefix")
    cut = reduce(DataFrame.unionByName, thresholds)
    return stage(goals.join(cut, NAME, "left").select(*NAME, "source_size", "target", "whole", "threshold"), "mix-plan")


def copies() -> Column:
    return F.col("whole") + F.coalesce((F.col("_key") < F.col("threshold")).cast("long"), F.lit(0))


def sizes(docs: DataFrame, size: Column | None = None) -> DataFrame:
    count = word_count(F.col("text")) if size is None else size
    return stage(named(docs.select("doc_id", "source", count.alias("size"))), "mix-sizes")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` has doc_id, source and text (for ``size``, by default the number of words);
    other columns, whatever their names, are not looked at. Returns doc_id, source, size,
    source_size, target and taken, a row per row of ``docs``; taken is a multiple of size.

    * null text or a text without words: size 0, taken 0; null source: a source of its own, last in order
    * null doc_id: all such rows share one key; equal ids share a key and are taken together
    * a source without words: target 0; no rows: no rows
    * a tie, where the boundary document brings the sum as near from above as leaving it
      out does from below, leaves it out; so a source misses its target by at most half of
      the documents with one key, and reruns agree
    """
    sized = sizes(docs, size)
    joined = lookup(sized, plan(sized, weights, max_repeat), NAME, spread=["_key"])
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed_rows(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever these are called; rows taken no time go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source")
    joined = lookup(named(rows), plan(sizes(docs, size), weights, max_repeat), NAME, spread=["_key"])
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")
