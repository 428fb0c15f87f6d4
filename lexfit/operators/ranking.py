"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexfit.operators.joins import spread_left_join
from lexfit.session import stage

SCALE = 10**15  # scores become whole numbers; 15 digits keep distinct ones apart
STEP = 10**5  # digits are taken five at a time
HOT_SHARE = 1000


def rank_table(counts: DataFrame, groups: list[str], code: str = "_code") -> DataFrame:
    """Descending average rank of each distinct score: ``(groups, code, n, rank)``.

    ``counts`` has one row per distinct score code and its number ``n`` of rows. The rank
    is a prefix sum over the digits of the code: how many rows lie above its leading
    digits, above its next five, above its last five. Every window partition holds at
    most 10^5 rows (the top one 10^5 per unit of score), however many rows the table has
    and however their scores are distributed.
    """
    counts = counts.withColumn("_mid", F.expr(f"{code} div {STEP}"))
    counts = counts.withColumn("_top", F.expr(f"_mid div {STEP}"))

    def above(df: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        w = W.partitionBy(*within).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    low = above(counts, [*groups, "_top", "_mid"], code, "_above_low")
    mid = counts.groupBy(*groups, "_top", "_mid").agg(F.sum("n").alias("n"))
    top = mid.groupBy(*groups, "_top").agg(F.sum("n").alias("n"))
    mid = above(mid, [*groups, "_top"], "_mid", "_above_mid").drop("n")
    top = above(top, groups, "_top", "_above_top").drop("n")
    joined = low.join(mid.join(top, [*groups, "_top"]), [*groups, "_top", "_mid"])
    first = F.col("_above_low") + F.col("_above_mid") + F.col("_above_top")
    return joined.select(*groups, code, "n", (first + (F.col("n") + 1) / 2).alias("rank"))


def score_histogram(df: DataFrame, groups: list[str], score: str) -> DataFrame:
    """``(groups, _code, n)``: how many rows have each score. Kept for each batch, histograms add up to that of all rows."""
    coded = df.select(*groups, F.round(F.col(score) * SCALE).cast("bigint").alias("_code"))
    return coded.where("_code is not null").groupBy(*groups, "_code").agg(F.count("*").alias("n"))


def merge_histograms(histograms: list[DataFrame], groups: list[str]) -> DataFrame:
    """One histogram of the rows of several; with ``n`` negated, rows that are gone are taken off."""
    every = reduce(DataFrame.unionByName, histograms)
    return every.groupBy(*groups, "_code").agg(F.sum("n").alias("n")).where("n > 0")


def rank_average(
    df: DataFrame, groups: list[str], score: str, row_key: list[str], name: str = "rank", histogram: DataFrame | None = None
) -> DataFrame:
    """Add the descending rank of ``score`` within ``groups``; ties get their mean rank,
    missing scores stay missing.

    ``df`` is read twice, once for its groups and scores only: hand in a stage table or
    a scan, not a long plan. Equal scores collapse before anything else; what is left is
    staged. Scores that own more than one row in a thousand of their group (zero, as a
    rule) are looked up by broadcast; there are at most a thousand of them per group.
    ``histogram`` may be that of more rows, of which ``df`` are some: then ranks are among
    all of those, whose scores are not read again.
    """
    counts = score_histogram(df, groups, score) if histogram is None else histogram
    ranks = stage(rank_table(stage(counts, "counts"), groups), "ranks")
    coded = df.withColumn("_code", F.round(F.col(score) * SCALE).cast("bigint"))
    totals = ranks.groupBy(*groups).agg(F.sum("n").alias("_total"))
    hot = ranks.join(F.broadcast(totals), groups).where(F.col("n") * HOT_SHARE > F.col("_total"))
    columns = [*groups, "_code", F.col("rank").alias(name)]
    out = spread_left_join(
        coded, ranks.select(*columns), [*groups, "_code"], hot=hot.select(*columns)
    )
    return out.drop("_code")


def rank_difference(left: str, right: str):
    """Absolute difference of two ranks."""
    return F.abs(F.col(left) - F.col(right))


def rank_agreement(df: DataFrame, difference: str = "rank_diff") -> DataFrame:
    """Mean rank difference per section."""
    return df.groupBy("section").agg(F.avg(difference).alias("mean_rank_diff"))
