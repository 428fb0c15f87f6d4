"""Blocklists kept as tables, against brute force."""

import random

from lexfit.operators import blocklist


def test_blocked_rows_equal_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdeäß "
    titles = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))).title() for _ in range(400)]
    titles += [None, None, "", "Ab", "a"] + ["hot title abc"] * 200
    terms = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))).upper() for _ in range(150)] + ["ß ", "Äß", None, "", "never there"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], "id bigint, title string, term string")
    listed = spark.createDataFrame([(t, 1) for t in terms * 2], "term string, title int")
    got = {r.id for r in blocklist.drop_blocked(df, listed.select("term")).collect()}
    words = [t.lower() for t in terms if t]
    want = {i for i, t in enumerate(titles) if t is None or not any(w in t.lower() for w in words)}
    assert got == want and 50 < len(want) < len(titles) - 50
    assert blocklist.drop_blocked(df, listed.select("term").limit(0)).count() == len(titles)
    assert blocklist.drop_blocked(df.limit(0), listed.select("term")).count() == 0


def test_a_term_is_filed_under_its_rarest_gram(spark):
    titles = spark.createDataFrame([("ring the bell",), ("the thing",), ("bring it",)], "title string")
    terms = spark.createDataFrame([("the thing",), ("a",), ("xyz",)], "term string")
    index, _ = blocklist.term_index(terms, titles)
    filed = {r.term: r.gram for r in index.collect()}
    assert filed["a"] == "a" and filed["xyz"] == "xyz" and filed["the thing"] not in ("the", "ing", "he ")


def test_large_list_meets_few_titles(spark):
    """Terms that share a frequent gram do not all meet the titles that have it."""
    terms = spark.range(20_000).selectExpr("concat('title number ', id) AS term")
    titles = spark.range(20_000, 40_000).selectExpr("concat('title number ', id) AS title")
    index, of_title = blocklist.term_index(terms, titles)
    assert of_title.join(index, "gram").count() < 20_000 * 20_000 / 50
