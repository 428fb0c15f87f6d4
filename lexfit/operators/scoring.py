"""Term counts, cosine, Jaccard and matched terms.

A text is one row, whose tokens are counted inside it; those that the query may hold are
looked up by a hash join. ``score_features`` reads the texts once and leaves a few numbers per text; the only corpus-wide fact, which query terms occur anywhere, is then an
aggregate over those. Adding texts later means rescoring from features, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions.text import vectorizer_tokens
from lexfit.operators.joins import value_filter

DIGITS = 12  # scores are rounded so that equal texts tie exactly


def _with_counts(df: DataFrame, text: str) -> DataFrame:
    """Add ``counts``: array<struct<token, tf>> of the text's vectoriser tokens.

    Sorted tokens are cut where the token changes: linear after the sort, no shuffle.
    """
    df = df.withColumn("_sorted", F.sort_array(vectorizer_tokens(F.col(text))))
    s, n = F.col("_sorted"), F.size("_sorted")
    indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(indexes, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    df = df.withColumn("_starts", starts)
    p = F.col("_starts")
    counts = F.transform(
        p,
        lambda i, k: F.struct(
            F.get(s, i).alias("token"),
            (F.coalesce(F.get(p, k + 1), n) - i).cast("bigint").alias("tf"),
        ),
    )
    return df.withColumn("counts", counts).drop("_sorted", "_starts")


def term_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Bag of words in long form, one row per text and token; ``key`` is unique."""
    counted = _with_counts(df.select(key, text), text)
    # The outer form: from an inner one the optimizer infers a filter on the array's
    # size and pushes it down to the scan, which works the array out a second time.
    return counted.select(key, F.inline_outer("counts")).where("token is not null")


def term_profiles(terms: DataFrame) -> DataFrame:
    """The query terms as a dictionary ``(section, kind, token, weight, places)``, of any length.

    Kind 0 are the tokens as the vectoriser sees them, with their counts; kind 1 are the
    terms as they are, with the places they have in the query.
    """
    tokens = terms.select("section", F.explode(vectorizer_tokens(F.col("term"))).alias("token"))
    counted = tokens.groupBy("section", "token").agg(F.count("*").alias("weight"))
    place = F.struct("pos", "sub_pos")
    listed = terms.groupBy("section", F.col("term").alias("token")).agg(F.count("*").alias("weight"), F.collect_list(place).alias("places"))
    no_place = F.lit(None).cast(listed.schema["places"].dataType).alias("places")
    counted = counted.select("section", F.lit(0).alias("kind"), "token", "weight", no_place)
    return counted.unionByName(listed.select("section", F.lit(1).alias("kind"), "token", "weight", "places"))


def score_features(
    df: DataFrame,
    keys: list[str],
    profiles: DataFrame,
    text: str = "text",
    sections: list[str] | None = None,
    vectors: bool = True,
) -> DataFrame:
    """Per text and section: dot product, squared length, overlap sizes, terms found.

    ``text`` holds blank-joined tokens; ``keys`` and section name a text. With ``sections``
    there is no such column: each text counts under all of them and is gone through once.
    Lengths and set sizes are worked out inside the row. Of its tokens only those leave it
    that the query may hold, to meet the dictionary in a hash join, so what is shuffled is a row
    of numbers per text and its matches. A section without terms keeps its rows and scores 0.
    ``vectors=False`` leaves out dot product, length and terms found, which only the cosine needs.
    """
    named = [] if sections else ["section"]
    counted = df.select(*keys, *named, text)
    counted = _with_counts(counted, text) if vectors else counted
    profiles = profiles if vectors else profiles.where("kind = 1")
    one, zero, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("string")
    held = value_filter(profiles, "token")
    # Columns of their own, worked out once a text: what is inside of a generator's argument
    # is worked out wherever it stands there.
    counted = counted.withColumn("_words", F.array_distinct(F.array_remove(F.split(text, " "), "")))
    squares = F.aggregate("counts", zero, lambda s, c: s + c["tf"] * c["tf"]) if vectors else zero
    counted = counted.withColumns({"_square": squares, "_n_words": F.size("_words").cast("bigint")})

    def entry(kind: int, token: Column, tf: Column, size: Column = zero, name: Column = none) -> Column:
        name = [name.alias("section")] if sections else []
        return F.struct(*name, F.lit(kind).alias("kind"), token.alias("token"), tf.alias("tf"), size.alias("size"))

    whole = F.array(*[entry(2, none, F.col("_square"), F.col("_n_words"), F.lit(s)) for s in sections or [""]])
    entries = [whole, F.transform("_words", lambda w: entry(1, w, one))]
    if vectors:
        entries.append(F.transform("counts", lambda c: entry(0, c["token"], c["tf"])))
    long = counted.select(*keys, *named, F.inline_outer(F.concat(*entries)))
    long = long.where((F.col("kind") == 2) | held(F.col("token")))
    if sections:
        found = profiles.withColumnRenamed("section", "_section")
        met = long.join(found, ["kind", "token"], "left").withColumn("section", F.coalesce("section", "_section"))
        met = met.where(F.col("section").isin(list(sections)))
    else:
        met = long.join(profiles, ["section", "kind", "token"], "left")
    is_vector = (F.col("kind") == 0) & F.col("weight").isNotNull()
    is_term = (F.col("kind") == 1) & F.col("weight").isNotNull()
    places = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["sub_pos"].alias("sub_pos"), F.col("token").alias("term")))
    vector_sums = [
        F.coalesce(F.sum(F.when(is_vector, F.col("tf") * F.col("weight"))), zero).alias("dot"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("tf"))), zero).alias("square"),
        F.collect_list(F.when(is_vector, F.col("token"))).alias("found"),
    ]
    summed = met.groupBy(*keys, "section").agg(
        *(vector_sums if vectors else []),
        F.flatten(F.collect_list(F.when(is_term, places))).alias("common"),
        F.count(F.when(is_term, one)).alias("n_common"),
        F.sum("size").alias("_n_tokens"),
    )
    sizes = profiles.where("kind = 1").groupBy("section").agg(F.count("*").alias("_n_terms"))
    summed = summed.join(F.broadcast(sizes), "section", "left")  # one row per section
    n_union = F.col("_n_tokens") + F.coalesce("_n_terms", zero) - F.col("n_common")
    return summed.withColumn("n_union", n_union).drop("_n_tokens", "_n_terms")


def found_terms(features: DataFrame) -> DataFrame:
    """Query terms that occur in the corpus; at most as many rows as there are terms."""
    return features.select("section", F.explode("found").alias("term")).distinct()


def corpus_vocabulary(df: DataFrame, terms: DataFrame, text: str = "text", sections: list[str] | None = None) -> DataFrame:
    """The query terms that the corpus knows, in query order.

    Tokens that are surely not in the query stay in their rows. With ``sections`` each text
    counts under all of them, as in ``score_features``.
    """
    wanted = terms.select("section", F.col("term").alias("token")).distinct()
    keys = ["token"] if sections else ["section", "token"]
    tokens = df.select(*keys[:-1], F.explode_outer(vectorizer_tokens(F.col(text))).alias("token"))
    tokens = tokens.where(F.col("token").isNotNull() & value_filter(wanted, "token")(F.col("token"))).distinct()
    known = wanted.where(F.col("section").isin(list(sections))) if sections else wanted
    known = known.join(tokens, keys, "left_semi").withColumnRenamed("token", "term")
    return terms.join(known, ["section", "term"], "left_semi")


def query_lengths(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Squared query length per section over the terms the corpus knows."""
    weights = profiles.where("kind = 0").select("section", F.col("token").alias("term"), "weight")
    known = found_terms(features).join(weights, ["section", "term"])
    return known.groupBy("section").agg(F.sum(F.col("weight") * F.col("weight")).alias("query_square"))


def cosine(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``cosine``; 0 where either vector is zero. One row per section is broadcast."""
    lengths = F.broadcast(query_lengths(features, profiles))
    length = F.sqrt("square") * F.sqrt("query_square")
    score = F.when(F.col("dot") > 0, F.round(F.col("dot") / length, DIGITS)).otherwise(0.0)
    return features.join(lengths, "section", "left").withColumn("cosine", score).drop("query_square")


def jaccard_score(n_common: Column, n_union: Column) -> Column:
    """Overlap over union; null if both sets are empty."""
    return F.round(F.try_divide(n_common, n_union), DIGITS)


def jaccard(features: DataFrame) -> DataFrame:
    """Add ``jaccard``."""
    return features.withColumn("jaccard", jaccard_score(F.col("n_common"), F.col("n_union")))


def matched(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """Add ``matched``: query terms found in the text, in query order with repeats, where
    the score is not 0."""
    words = F.transform(F.sort_array("common"), lambda c: c["term"])
    return scored.withColumn("matched", F.when(F.col(score) != 0, F.array_join(words, " ")))


def total_score(prefix: str = "", suffix: str = "", weights: dict[str, float] = fx.TOTAL_WEIGHTS) -> Column:
    """Weighted sum over the sections' columns; any missing part gives a missing total."""
    total = None
    for section, weight in weights.items():
        part = F.col(f"{prefix}{section}{suffix}") * F.lit(weight)
        total = part if total is None else total + part
    return total
