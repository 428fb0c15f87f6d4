"""Token-level normalisation of corpora and of query term lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit.functions.stemming import cistem, snowball_german
from lexfit.functions.text import clean_text, first_word, remove_stopwords
from lexfit.operators.joins import may_hold, value_bits


def stem_text(text: Column) -> Column:
    """Both stemmers in turn on every token of a blank-joined text."""
    return cistem(snowball_german(text))


def _by_dictionary(df: DataFrame, key: str, text: str, dictionary: DataFrame, put: Callable[[Column, Column], Column]) -> DataFrame:
    """``(key, text)``: the texts with each token of ``dictionary(token, value)`` replaced by the words of
    ``put(token, value)``, an array. ``key`` is unique.

    A text stays one row. Beside it go only those of its distinct tokens that the dictionary
    may hold, each once with all its places; the words are put back by place. A dictionary
    entry that comes several times counts with its least value. The planner joins by
    broadcast or shuffle as the dictionary's bytes allow.
    """
    entries = dictionary.where("token is not null").groupBy("token").agg(F.min("value").alias("value"), F.lit(True).alias("listed"))
    place = F.transform(F.split("_text", " "), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
    df = df.select(key, F.col(text).alias("_text"), value_bits(entries, "token").alias("_bits"))
    # tokens that are surely not listed are left out before anything is sorted
    held = F.filter(place, lambda w: may_hold(F.col("_bits"), w["token"]))
    df = df.select(key, "_text", F.sort_array(held).alias("_sorted"))
    s, n = F.col("_sorted"), F.size("_sorted")
    indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_starts", F.filter(indexes, lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"])))
    p = F.col("_starts")

    def own(i: Column, k: Column) -> Column:
        # place by place: slice() goes through the whole array each time
        places = F.transform(F.sequence(i, F.coalesce(F.get(p, k + 1), n) - 1), lambda j: F.get(s, j)["pos"])
        return F.struct(F.lit(False).alias("whole"), F.get(s, i)["token"].alias("token"), places.alias("places"), F.lit(None).cast("string").alias("text"))

    # the text's own row has a token that is no word and differs between texts
    alone = F.concat(F.lit("\0 "), F.xxhash64(key).cast("string"))
    none = F.array().cast("array<int>")
    whole = F.array(F.struct(F.lit(True).alias("whole"), alone.alias("token"), none.alias("places"), F.col("_text").alias("text")))
    long = df.select(key, F.inline_outer(F.concat(whole, F.coalesce(F.transform(p, own), F.array().cast("array<struct<whole:boolean,token:string,places:array<int>,text:string>>")))))
    found = long.join(entries, "token", "left").where(F.col("whole") | F.col("listed"))
    values = F.transform("places", lambda i: F.struct(i.alias("pos"), F.col("token").alias("token"), F.col("value").alias("value")))
    found = found.groupBy(key).agg(F.first("text", ignorenulls=True).alias("_text"), F.flatten(F.collect_list(F.when(~F.col("whole"), values))).alias("_values"))
    found = found.select(key, "_text", F.sort_array("_values").alias("_values"))
    v = F.col("_values")
    found = found.withColumn("_values", F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1)["pos"] != x["pos"])))
    found = found.withColumn("_words", F.when(F.size("_values") > 0, F.split("_text", " ")))

    def between(start: Column, end: Column) -> Column:
        words = F.transform(F.sequence(start, end - 1), lambda j: F.get("_words", j))
        return F.when(start < end, words).otherwise(F.array().cast("array<string>"))

    pieces = F.transform(v, lambda x, i: F.concat(between(F.coalesce(F.get(v, i - 1)["pos"], F.lit(-1)) + 1, x["pos"]), put(x["token"], x["value"])))
    tail = between(F.get(v, F.size(v) - 1)["pos"] + 1, F.size("_words"))
    replaced = F.array_join(F.flatten(F.concat(pieces, F.array(tail))), " ")
    return found.select(key, F.when(F.size(v) > 0, replaced).otherwise(F.col("_text")).alias(text))


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame) -> DataFrame:
    """``(key, text)`` with each token replaced by its entry in ``lemmas(token, lemma)``; null stays null."""
    dictionary = lemmas.select("token", F.col("lemma").alias("value"))
    return _by_dictionary(df, key, text, dictionary, lambda token, value: F.array(F.coalesce(value, token)))


def drop_listed_tokens(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``(key, text)`` without the tokens of ``words(token)``, a stop list kept as a table."""
    dictionary = words.select("token", F.lit(None).cast("string").alias("value"))
    return _by_dictionary(df, key, text, dictionary, lambda token, value: F.array().cast("array<string>"))


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Distinct tokens with their count; each task counts its own before the shuffle."""
    tokens = df.select(F.explode_outer(F.split(text, " ")).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def stem_dictionary(tokens: DataFrame) -> DataFrame:
    """Both stems of each distinct token."""
    stem1 = snowball_german(F.col("token"))
    return tokens.select("token", stem1.alias("stem1"), cistem(stem1).alias("stem2"))


def prepare_terms(
    terms: DataFrame,
    lemmas: DataFrame | None = None,
    stop_words: list[str] | None = None,
    stem: bool = True,
    split_phrases: bool = False,
) -> DataFrame:
    """Term list ``(section, pos, term)`` through the same steps as the corpus.

    Of a phrase only the first word counts, as the usual per-term lemma step has it;
    ``split_phrases`` keeps every word. Terms without a word are dropped.
    """
    cleaned = clean_text(F.col("term"))
    words = F.split(F.trim(F.regexp_replace(cleaned, r"\s+", " ")), " ")
    if split_phrases:
        out = terms.select("section", "pos", F.posexplode(words).alias("sub_pos", "term"))
    else:
        out = terms.select("section", "pos", F.lit(0).alias("sub_pos"), first_word(cleaned).alias("term"))
    out = out.where(F.col("term") != "")
    if lemmas is not None:
        out = out.join(lemmas.withColumnRenamed("token", "term"), "term", "left")
        out = out.select("section", "pos", "sub_pos", F.coalesce("lemma", "term").alias("term"))
    if stem:
        out = out.withColumn("term", stem_text(F.col("term")))
    if stop_words:
        out = out.where(F.size(remove_stopwords(F.array("term"), stop_words)) > 0)
    return out.select("section", "pos", "sub_pos", "term")
