"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into segments, each with its own index from segment value to codes. Round
a probes, for every unfinished query and segment, all values at distance exactly a from
the query's. After it, every code within ``segments * (a + 1) - 1`` bits has been met: a
code further than a from the query in all its segments is at least ``segments * (a + 1)``
bits away. A query is finished when its k-th verified distance is within that bound.

Equal codes are one entry with its k smallest ids, and equal queries are one query, so
that a code held by a large share of the rows is neither a large list nor many probes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfit.session import stage


def segment_bits(rows: int, width: int) -> int:
    """About the logarithm of the number of rows, so that a list holds a few codes, and the
    same for all segments of a code: one short segment would have long lists."""
    bits = min(32, max(4, rows.bit_length() - 1))
    return -(-width // -(-width // bits))


def binary_code(vector: Column, width: int, bits: int) -> Column:
    """Segments of ``bits`` signs each: bit i is set where the value is over 0; null values are not."""
    values = lambda at: F.slice(vector, at * bits + 1, F.lit(bits))
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    segment = lambda at: F.aggregate(F.transform(values(at), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-width // bits) - 1)), segment)


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def masks(bits: int, weight: int) -> Column:
    """All values of ``bits`` bits of which ``weight`` are set, folded into a literal."""
    text = ",".join(str(sum(1 << i for i in places)) for places in combinations(range(bits), weight))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, neighbour_id, distance and rank (from 1) of the k nearest of ``rows`` to each of ``queries``.

    Both have id and vector; other columns are not read. All rows are searched, the
    query's own included; equal distances are ordered by id.

    * a null vector, or one whose length isn't the table's largest, is neither found nor answered
    * a null id is not found; repeated rows are found, and answered, each
    * fewer than k rows: all of them; no rows: no rows
    """
    width, count = rows.agg(F.max(F.size("vector")), F.count("*")).first()
    width = max(width or 0, 1)
    bits = segment_bits(count, width)
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == width)
    code = binary_code(F.col("vector"), width, bits)
    codes = rows.where(usable).select("id", code.alias("code"))
    asked = stage(queries.where(usable).select(F.col("id").alias("query_id"), code.alias("query")), "mih-queries")
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = stage(codes.withColumn("place", first).where(F.col("place") <= k), "mih-codes")
    entries = stage(ids.groupBy("code").agg(F.max("place").alias("held")), "mih-entries")
    total = entries.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    index = stage(entries.select("code", "held", F.posexplode("code").alias("segment", "value")), "mih-index")
    segments = -(-width // bits)

    # a query carries the distance of its k-th code so far; what lies beyond needs no further look
    open_queries = stage(asked.select("query", F.lit(segments * bits).alias("bound")).distinct(), "mih-open")
    best, done, radius = None, [], 0
    while radius <= bits and not open_queries.isEmpty():
        probes = open_queries.select("query", "bound", F.posexplode("query").alias("segment", "at"))
        probes = probes.select("query", "bound", "segment", "at", F.explode(masks(bits, radius)).alias("mask"))
        probes = probes.select("query", "bound", "segment", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))
        # the planner takes the probes to be as few as the queries, and would broadcast them
        met = probes.hint("merge").join(index, ["segment", "value"])
        met = met.select("query", "bound", "code", "held", distance(F.col("query"), F.col("code")).alias("distance"))
        met = met.where("distance <= bound").drop("bound")
        if best is not None:
            met = met.unionByName(best)
        met = met.distinct()
        order = Window.partitionBy("query").orderBy("distance", "code")
        near = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
        # ties on the last distance: an entry beyond the k-th place may hold a smaller id
        near = met.join(near.groupBy("query").agg(F.max("distance").alias("last"), F.count("*").alias("n")), "query")
        near = near.where((F.col("n") < k) | (F.col("distance") <= F.col("last"))).drop("last", "n")
        best = stage(near, "mih-best")
        upto = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
        kth = best.withColumn("upto", F.sum("held").over(upto)).where(F.col("upto") >= min(k, total)).groupBy("query").agg(F.min("distance").alias("kth"))
        covered = segments * (radius + 1) - 1
        kth = stage(kth, "mih-kth")
        finished = stage(kth.where((F.col("kth") <= covered) | F.lit(total <= k)).select("query"), "mih-finished")
        done.append(best.join(finished, "query", "left_semi"))
        left = open_queries.join(finished, "query", "left_anti").withColumnRenamed("bound", "was").join(kth, "query", "left")
        open_queries = stage(left.select("query", F.coalesce("kth", "was").alias("bound")), "mih-open")
        best = best.join(open_queries.select("query"), "query", "left_semi")
        radius += 1
    if not done:
        return asked.select("query_id", F.lit(None).cast(rows.schema["id"].dataType).alias("neighbour_id"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    top = found.select("query", "code", "distance").join(ids.select("code", "id"), "code").withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(stage(top.select("query", "id", "distance", "rank"), "mih-top"), "query").select("query_id", F.col("id").alias("neighbour_id"), "distance", "rank")
