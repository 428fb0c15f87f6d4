"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 20
BROADCAST_ROWS = 500_000  # most rows a lookup side may have to be broadcast
BROADCAST_BYTES = 64 << 20  # and most bytes
HOT_ROW_BYTES = 16 << 10  # most bytes of a row that is broadcast for a hot key


def row_bytes(*columns: str) -> Column:
    """About the size of a row: its JSON, and some bytes for the row itself."""
    return F.octet_length(F.to_json(F.struct(*columns))) + 16


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows of ``max_bytes`` together; stops right after so many rows."""
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(row_bytes(*df.columns)).alias("size")).first()
    return found["n"] <= max_rows and (found["size"] or 0) <= max_bytes


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    needed: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join with a ``right`` that is unique on ``on``.

    ``hot`` holds the right rows of keys that own many left rows; the caller bounds
    their number. Those of at most HOT_ROW_BYTES are broadcast; larger ones are left to the
    shuffled join, whose skewed partitions the adaptive planner splits. Left rows that are resolved that way, or that need no
    partner (``needed`` false or a null key), are a narrow branch and never move; only
    the rest is shuffled, and no key of it owns many rows. ``left`` is read by both
    branches: hand in a stage table.
    """
    values = [c for c in right.columns if c not in on]
    names = list(left.columns)
    need = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
    for key in on:
        need = need & F.col(key).isNotNull()
    found = right.select(*on, F.struct(*values).alias("_found"))
    none = F.lit(None).cast(found.schema["_found"].dataType)
    if hot is not None:
        hot = hot.where(row_bytes(*hot.columns) <= HOT_ROW_BYTES)
        left = left.join(F.broadcast(hot.select(*on, F.struct(*values).alias("_hot"))), on, "left")
        need, settled = need & F.col("_hot").isNull(), F.col("_hot").cast(found.schema["_found"].dataType)
    else:
        settled = none
    stays = left.where(~need).select(*names, settled.alias("_found"))
    moves = left.where(need).select(*names).join(found, on, "left").select(*names, "_found")
    return stays.unionByName(moves).select(*names, *[F.col(f"_found.{v}").alias(v) for v in values])


def frequent(df: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Keys that own more than one row in ``share``: at most ``share`` of them."""
    counts = df.groupBy(*keys).count()
    total = counts.agg(F.sum("count")).scalar()
    return counts.where(F.col("count") * share > total).select(*keys)


def value_bits(values: DataFrame, *columns: str) -> Column:
    """``columns`` of ``values`` as bits of an array of fixed size, whatever their number: a subquery of the
    plan that uses it, worked out once. A lambda can have it by the name of a column only."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    words = values.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = values.sparkSession.range(0, FILTER_BITS // 64, 1, 1).join(words, F.col("id") == F.col("word"), "left")
    rows = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(rows, lambda r: r["bits"])).scalar()


def may_hold(bits: Column, *values: Column) -> Column:
    """False if ``values`` are surely not among those of ``bits``; true among them and for a few others."""
    at = F.pmod(F.xxhash64(*values), F.lit(FILTER_BITS))
    word = F.get(bits, F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def value_filter(values: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test for values: false surely not among ``columns`` of ``values``, true among them or one of a few others.

    A large table can be cut down by it in place before it is shuffled. Use it outside of lambdas.
    """
    bits = value_bits(values, *columns)
    return lambda *values: may_hold(bits, *values)
