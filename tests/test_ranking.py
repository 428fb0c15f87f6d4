import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexfit.operators import ranking
from lexfit.operators.joins import frequent, is_small, spread_left_join


def check(spark, groups):
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, id bigint, score double")
    got = {(r.g, r.id): r.rank for r in ranking.rank_average(df, ["g"], "score", ["id"]).collect()}
    assert len(got) == len(rows)
    for g, values in groups.items():
        want = pd.Series(values, dtype=float).rank(ascending=False)
        for i, rank in enumerate(want):
            assert got[g, i] == (None if pd.isna(rank) else rank), (g, i)


def test_ranks_equal_pandas(spark):
    rng = random.Random(4)
    check(
        spark,
        {
            "ties": [rng.randint(0, 20) / 20 for _ in range(300)],
            "nulls": [None, 0.5, None, 0.5, 0.1],
            "equal": [0.0] * 50,
            "single": [0.3],
            "only null": [None, None],
            "hot": [0.0] * 400 + [0.25] * 300 + [rng.random() for _ in range(300)],
            "close": [0.1 + k * 1e-12 for k in range(200)] + [0.5] * 3,
            "above one": [2.5, 1.75, 0.0, 2.5],
        },
    )


def test_rank_sum(spark):
    df = spark.range(1, 501).select(F.lit("g").alias("g"), "id", (F.col("id") % 7 / 7).alias("score"))
    total = ranking.rank_average(df, ["g"], "score", ["id"]).agg(F.sum("rank")).first()[0]
    assert total == 500 * 501 / 2


def test_rank_agreement(spark):
    df = spark.createDataFrame([("tasks", 1.0, 4.0), ("tasks", 2.0, 1.0), ("profile", 1.0, 1.0)], "section string, a double, b double")
    df = df.withColumn("rank_diff", ranking.rank_difference("a", "b"))
    assert {tuple(r) for r in ranking.rank_agreement(df).collect()} == {("tasks", 2.0), ("profile", 0.0)}


@pytest.mark.parametrize("use_hot", [True, False])
def test_spread_left_join(spark, use_hot):
    keys = ["hot"] * 500 + [None] * 100 + [f"k{i}" for i in range(200)]
    left = spark.createDataFrame(list(enumerate(keys)), "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None), ("other", 4)], "k string, v int")
    hot = right.join(frequent(left, ["k"], 10), "k", "left_semi") if use_hot else None
    joined = spread_left_join(left, right, ["k"], F.col("id") < 750, hot)
    out = joined.collect()
    table = {"hot": 1, "k1": 2}
    assert len(out) == len(keys)
    for r in out:
        # Rows not needed are left unmatched, unless the broadcast part resolves them anyway.
        assert r.v == table.get(keys[r.id])


def test_large_values_of_hot_keys_are_not_broadcast(spark):
    """A hot key with a long value is joined all the same, but not by the broadcast part."""
    left = spark.range(600).select("id", F.when(F.col("id") < 400, "long").when(F.col("id") < 550, "short").otherwise("none").alias("k"))
    right = spark.createDataFrame([("long", "x" * 100_000), ("short", "y")], "k string, v string")
    out = spread_left_join(left, right, ["k"], hot=right)
    assert {(r.k, r.n): r["count"] for r in out.groupBy("k", F.length("v").alias("n")).count().collect()} == {("long", 100_000): 400, ("short", 1): 150, ("none", None): 50}
    moved = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "16384" in line]
    assert moved  # the bound is part of the plan


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("v"))
    assert is_small(df) and is_small(df.limit(0)) and not is_small(df, max_rows=99) and not is_small(df, max_bytes=50_000)
    assert is_small(df.select(F.lit(None).cast("string").alias("v")))


def test_hot_and_missing_keys_stay_in_place(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        key = F.when(F.col("id") % 10 < 5, "hot").when(F.col("id") % 10 < 9, None).otherwise(F.concat(F.lit("k"), "id"))
        left = spark.range(0, 20000, 1, 8).select("id", key.alias("k"))
        right = left.where("k is not null").select("k").distinct().withColumn("v", F.lit(1)).repartition(3)
        hot = right.join(F.broadcast(frequent(left.where("k is not null"), ["k"], 10)), "k", "left_semi")
        sizes = spread_left_join(left, right, ["k"], hot=hot).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 20000
    assert max(r["count"] for r in sizes) <= 3 * 20000 / len(sizes)


def test_frequent_and_small(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 9 + [("c",)], "k string")
    assert [r.k for r in frequent(df, ["k"], 10).collect()] == ["a"]
    assert is_small(df, 100) and not is_small(df, 99)


def test_ranks_from_histograms_of_batches(spark):
    """Histograms of two batches, and one of rows taken off, rank like a full run."""
    rows = [("a" if i % 3 else "b", float(i % 7) / 7 if i % 11 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, id bigint")
    first, second, gone = df.where("id < 120"), df.where("id >= 120"), df.where("id % 5 = 0")
    histograms = [ranking.score_histogram(x, ["g"], "s") for x in (first, second, gone)]
    histograms[2] = histograms[2].withColumn("n", -histograms[2]["n"])
    merged = ranking.merge_histograms(histograms, ["g"])
    left = df.where("id % 5 <> 0")
    got = sorted(map(tuple, ranking.rank_average(left, ["g"], "s", ["id"], histogram=merged).collect()), key=str)
    assert got == sorted(map(tuple, ranking.rank_average(left, ["g"], "s", ["id"]).collect()), key=str)
