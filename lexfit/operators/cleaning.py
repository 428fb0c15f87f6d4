"""Row cleaning: keep-first, title filters, column replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import records as R
from lexfit.functions.text import clean_text, squeeze
from lexfit.operators.joins import is_small, value_filter
from lexfit.session import stage


def dedupe_first(df: DataFrame, key: str = "url", order: tuple[str, ...] = ("batch_no", "pos")) -> DataFrame:
    """One row per key, the first in ``order``; of rows that tie, any one.

    Keys and order are read first and are all that is shuffled of most rows: a row whose
    key surely has no copy stays where it is. Of the others only those that are first in
    order, or of which that is not yet sure, meet the list of keys with copies. ``df`` is
    read more than once: hand in a scan, a narrow plan over one, or a stage table.
    """
    at = F.struct(*order)
    counts = df.groupBy(key).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    copies = stage(counts.where("_n > 1").select(F.col(key).alias("_key"), "_first"), "copies")
    several = value_filter(copies, "_key")(F.col(key))
    joined = df.where(several).join(copies, F.col(key).eqNullSafe(F.col("_key")), "left")
    first = joined.where(F.col("_first").isNotNull() & (at == F.col("_first")))
    tied = first.groupBy(key).count().where("count > 1").isEmpty()
    first = first.select(*df.columns) if tied else first.select(*df.columns).dropDuplicates([key])
    only = joined.where(F.col("_first").isNull()).select(*df.columns)
    return df.where(~several).unionByName(only).unionByName(first)


def dedupe_first_table(
    df: DataFrame, key: str = "url", order: tuple[str, ...] = ("batch_no", "pos")
) -> DataFrame:
    """``dedupe_first`` for a stored table: same rows, without shuffling whole rows where
    few keys have copies.

    Key and order columns are read first (column pruning leaves the texts alone). If the
    keys with copies fit a broadcast and no two first copies tie, later copies are filtered
    out where they are; otherwise the rows go through the aggregate.
    """
    keys = df.select(key, F.struct(*order).alias("_order"))
    firsts = keys.groupBy(key).agg(F.min("_order").alias("_first"), F.count("*").alias("_n"))
    firsts = stage(firsts.where("_n > 1").select(F.col(key).alias("_key"), "_first"), "copies")
    if not is_small(firsts):
        return dedupe_first(df, key, order)
    same = F.col(key).eqNullSafe(F.col("_key"))
    winners = keys.join(F.broadcast(firsts), same & (F.col("_order") == F.col("_first")))
    if not winners.groupBy(key).count().where("count > 1").isEmpty():
        return dedupe_first(df, key, order)
    marked = df.join(F.broadcast(firsts), same, "left")
    first_or_only = F.col("_first").isNull() | (F.struct(*order) == F.col("_first"))
    return marked.where(first_or_only).select(*df.columns)


def new_rows(batch: DataFrame, store: DataFrame, key: str = "url") -> DataFrame:
    """First row per key of the batch, without keys the store has."""
    return dedupe_first(batch, key).join(store.select(key), key, "left_anti")


def title_blocklist(df: DataFrame, terms: list[str] = fx.TITLE_BLOCKLIST, title: str = "title") -> DataFrame:
    """Drop rows whose title holds a listed term; rows without a title stay."""
    return df.where(~R.title_blocked(F.col(title), terms))


def replace_columns(df: DataFrame, rules: list[tuple[str, str, list[str]]] = fx.REPLACEMENTS) -> DataFrame:
    """All replacement rules in one projection."""
    named = {c for _, _, columns in rules for c in columns}
    return df.select(*[R.replace_multi(c, rules) if c in named else F.col(c) for c in df.columns])


def language_text(parts: Column) -> Column:
    """Part 1 and part 2 with a blank between; a missing part is skipped."""
    return F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def token_text(text: Column) -> Column:
    """Cleaned tokens as one string with single blanks; '' for a missing text."""
    return F.coalesce(squeeze(clean_text(text)), F.lit(""))
