"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfit.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component), the smallest node reachable, for every node with an edge.

    A large star ties a node's larger neighbours to its smallest, a small star ties its
    smaller ones; in turn they leave one star per component after a number of rounds that
    is logarithmic in its size. Minima combine before their shuffle, and the joins on a
    node are plain, so that the adaptive planner may split a node with many neighbours.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        low = stage(low, "cc-low")
        large = stage(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc-large")
        # every edge now points from the larger node down
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        down = large.join(least, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        small = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-small")
        if small.join(current, ["a", "b"], "left_anti").isEmpty() and current.join(small, ["a", "b"], "left_anti").isEmpty():
            break
        current = small
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stage(pairs.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "cc-done")
