"""Title filter by a blocklist of any size: a q-gram index for containment.

A title that holds a term holds all of the term's q-grams. Each term is filed under one of
them, the one that the fewest titles have, and meets only the titles that have it; what
meets is verified. There is no pattern over all terms and no pair of a title and a term
that do not share their rarest q-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.operators.joins import value_filter
from lexfit.session import stage

Q = 3


def grams(text: Column, q: int) -> Column:
    """Distinct runs of ``q`` characters; none in shorter texts."""
    n = F.length(text) - q + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(q))))


def term_index(terms: DataFrame, titles: DataFrame, q: int = Q) -> tuple[DataFrame, DataFrame]:
    """``(gram, term)``, one row per term, and ``(title, gram)`` for the grams that terms have; both staged.

    A term shorter than ``q`` is filed under itself, so titles are cut into grams of the
    lengths that occur among the terms' grams. The grams of titles are counted where they
    are, and only those that some term has are counted at all.
    """
    lengths = [r[0] for r in terms.select(F.least(F.length("term"), F.lit(q))).distinct().collect()]  # at most q numbers
    of_term = terms.select("term", F.explode(F.coalesce(*[F.when(F.least(F.length("term"), F.lit(q)) == n, grams(F.col("term"), n)) for n in lengths or [q]])).alias("gram"))
    of_term = stage(of_term, "block-terms")
    of_title = titles.select("title", F.explode_outer(F.concat(*[grams(F.col("title"), n) for n in lengths or [q]])).alias("gram"))
    of_title = of_title.where(F.col("gram").isNotNull() & value_filter(of_term, "gram")(F.col("gram")))
    of_title = stage(of_title, "block-titles")
    often = of_title.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")
    chosen = of_term.join(often, "gram", "left").groupBy("term").agg(rarest)
    return stage(chosen.select(F.col("m.gram").alias("gram"), "term"), "block-index"), of_title


def blocked_titles(titles: DataFrame, terms: DataFrame, q: int = Q) -> DataFrame:
    """The distinct ``title`` values, in lower case, that hold a term."""
    wanted = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    lowered = stage(titles.select(F.lower("title").alias("title")).where("title is not null").distinct(), "block-distinct")
    index, of_title = term_index(stage(wanted, "block-wanted"), lowered, q)
    met = of_title.join(index, "gram").where(F.contains("title", "term"))
    return met.select("title").distinct()


def drop_blocked(df: DataFrame, terms: DataFrame, title: str = "title", q: int = Q) -> DataFrame:
    """``df`` without the rows whose title holds a term of the table ``terms`` (term), ignoring case.

    Terms are texts, not patterns; null and empty ones block nothing. Rows without a title
    stay. Rows whose title is surely not blocked stay where they are.
    """
    blocked = stage(blocked_titles(df.select(F.col(title).alias("title")), terms, q), "blocked")
    lowered = F.lower(title)
    doubtful = F.col(title).isNotNull() & value_filter(blocked, "title")(lowered)
    rest = df.where(doubtful).join(blocked.withColumnRenamed("title", "_blocked"), lowered == F.col("_blocked"), "left_anti")
    return df.where(~doubtful).unionByName(rest)
