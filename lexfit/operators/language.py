"""Language detection from character trigrams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.functions.text import char_trigrams
from lexfit.operators.joins import is_small
from lexfit.session import stage

#: Logarithms are kept as whole numbers of this fraction, so that their sums are exact in any order.
UNIT = 10**9
#: Languages whose sums share a row.
BLOCK = 8


def _units(value: Column) -> Column:
    return F.round(F.log(value) * UNIT).cast("bigint")


def _coded(points: Callable[[int], Column]) -> Column:
    """A trigram as one number: its code points, 21 bits each."""
    first, second, third = (points(k).cast("bigint") for k in range(3))
    return F.shiftleft(first, 42).bitwiseOR(F.shiftleft(second, 21)).bitwiseOR(third)


def _code(gram: Column) -> Column:
    return _coded(lambda k: F.ascii(F.substring(gram, k + 1, 1)))


def _gram(code: Column) -> Column:
    points = [F.shiftright(code, shift).bitwiseAND(F.lit((1 << 21) - 1)) for shift in (42, 21, 0)]
    return F.decode(F.unhex(F.format_string("%08x%08x%08x", *points)), "UTF-32")


def _each_gram(df: DataFrame, text: str, *columns: Column | str) -> DataFrame:
    """``(columns, code)``: a row per trigram of a text, as a number; a text without any is a row without one.

    The code points are an array, out of which generated code cuts the trigrams: no
    pattern search, and no string for each.
    """
    df = df.select(*columns, F.transform(F.split(F.col(text), ""), F.ascii).alias("_points"))
    last = F.size("_points") - 3
    df = df.withColumn("_at", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return df.withColumn("code", _coded(lambda k: F.get("_points", F.col("_at") + k))).drop("_points", "_at")


def language_model(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The model as a long table ``(gram, lang, log)``, of any number of trigrams and languages.

    A trigram's probability in a language is (count + 1) / (total + distinct trigrams). A row
    with a trigram holds the logarithm of its count + 1; what all trigrams of a language share,
    counted or not, is its row without a trigram: minus the logarithm of the denominator.
    The texts are read once, and each task counts its own trigrams before the shuffle.
    """
    grams = _each_gram(labelled.where(F.col(lang).isNotNull()), text, F.col(lang).alias("lang")).where("code is not null")
    counts = grams.groupBy("lang", "code").agg(F.count("*").alias("n"))
    counts = stage(counts.select("lang", _gram(F.col("code")).alias("gram"), "n"), "grams")
    distinct = counts.select("gram").distinct().agg(F.count("*")).scalar()
    base = counts.groupBy("lang").agg((-_units(F.sum("n") + distinct)).alias("log"))
    seen = counts.select("gram", "lang", _units(F.col("n") + 1).alias("log"))
    return stage(seen.unionByName(base.withColumn("gram", F.lit(None).cast("string"))), "model")


def text_grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, gram, n)``: the trigrams of each text, counted inside its row."""
    ordered = F.sort_array(char_trigrams(F.col(text)))
    df = df.select(key, ordered.alias("_grams"))
    s, n = F.col("_grams"), F.size("_grams")
    indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_starts", F.filter(indexes, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
    p = F.col("_starts")
    counts = F.transform(
        p, lambda i, k: F.struct(F.get(s, i).alias("gram"), (F.coalesce(F.get(p, k + 1), n) - i).cast("bigint").alias("n"))
    )
    return df.select(key, F.inline_outer(counts))


def detect_language(df: DataFrame, key: str, model: DataFrame, text: str = "text") -> DataFrame:
    """``(key, detected)``: the language with the highest sum of log probabilities over
    the text's trigrams; null for a text without a known trigram. Ties go to the name
    that sorts first. ``key`` is unique.

    The trigrams of a text meet the model, one row per trigram, where they are if the model
    is small enough for a broadcast. Of a larger model only the distinct trigrams of a text, counted
    inside its row, move to meet it. The sums are of whole numbers, so the result is the same.
    """
    base = model.where("gram is null").select("lang", F.col("log").alias("base"))
    bases = base.agg(F.array_sort(F.collect_list(F.struct("lang", "base"))).alias("_bases"))  # a row per language
    order = bases.select(F.posexplode("_bases.lang").alias("place", "lang"))
    names = [f"log{k}" for k in range(BLOCK)]
    slots = [F.coalesce(F.sum(F.when(F.col("place") % BLOCK == k, F.col("log"))), F.lit(0)).alias(name) for k, name in enumerate(names)]
    placed = model.where("gram is not null").join(F.broadcast(order), "lang")
    blocks = placed.groupBy("gram", F.expr(f"place div {BLOCK}").alias("block")).agg(*slots)
    # the first block of a trigram counts it as one that the model knows
    logs = F.transform(
        F.collect_list(F.struct("block", *names)),
        lambda x, i: F.struct(x["block"].alias("block"), *[x[name].alias(name) for name in names], (i == 0).cast("bigint").alias("known")),
    )
    by_gram = blocks.groupBy("gram").agg(logs.alias("logs"))
    if is_small(by_gram):
        grams = _each_gram(df, text, key).withColumn("n", F.lit(1).cast("bigint"))
        met = grams.join(F.broadcast(by_gram.select(_code(F.col("gram")).alias("code"), "logs")), "code", "left")
    else:
        met = text_grams(df, key, text).join(by_gram, "gram", "left")
    found = met.select(key, "n", F.inline_outer("logs"))
    sums = found.groupBy(key, "block").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in [*names, "known"]])
    by_block = F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", F.array(*names).alias("logs"))))
    by_key = sums.groupBy(key).agg(F.sum("known").alias("_known"), by_block.alias("_sums"))
    by_key = by_key.withColumn("_bases", bases.scalar())

    def score(b: Column, i: Column) -> Column:
        own = F.filter("_sums", lambda s: s["block"] == F.floor(i / BLOCK))
        return F.coalesce(F.get(F.get(own, F.lit(0))["logs"], i % BLOCK), F.lit(0)) + F.col("_known") * b["base"]

    costs = F.transform("_bases", lambda b, i: F.struct((-score(b, i)).alias("cost"), b["lang"].alias("lang")))
    return by_key.select(key, F.when(F.col("_known") > 0, F.array_min(costs)["lang"]).alias("detected"))
