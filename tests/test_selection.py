from pyspark.sql import functions as F

from lexfit.operators import cleaning, language, selection

from . import plain  # noqa: F401

SCORES = "tasks_jaccard double, profile_jaccard double, benefits_jaccard double, total_jaccard double, letter_done string"


def test_eligible(spark):
    rows = [
        (0.05, 0.03, 0.01, 0.0, None),  # three sections over
        (0.044, 0.03, 0.01, 0.0, None),  # exactly met is not over
        (0.05, 0.022, 0.01, 0.0, None),
        (0.05, 0.03, 0.0, 0.0, None),
        (0.0, 0.0, 0.0, 0.091, None),  # total only
        (0.0, 0.0, 0.0, 0.09, None),
        (0.5, 0.5, 0.5, 0.9, "Ja"),  # done already
        (0.5, 0.5, 0.5, 0.9, "Nein"),
        (None, 0.5, 0.5, None, None),
        (None, 0.5, 0.5, 0.2, None),
    ]
    df = spark.createDataFrame(rows, SCORES)
    got = [r.e for r in df.select(selection.eligible().alias("e")).collect()]
    assert got == [True, False, False, False, True, False, False, True, False, True]
    assert selection.select_eligible(df).count() == 4


def test_status_and_outbox(spark):
    rows = [
        (1, "Fa:1", "Chef", "a@b.de", None, None, None, True),
        (2, "Fa", "T", "a@b.de,c@d.de", "Ja", "Old", None, False),
        (3, "Fa", "T", None, "Ja", "Old", None, False),
        (4, "Fa", "T", "  ", "Ja", "Old", None, False),
        (5, "Fa", "T", "a@b.de", "Ja", "Old", "Ja", False),
        (6, "Fa", "T", "a@b.de", None, None, None, False),
    ]
    df = spark.createDataFrame(
        rows, "url bigint, company string, title string, email string, letter_done string, file_name string, sent string, chosen boolean"
    )
    marked = selection.mark_done(df, F.col("chosen")).cache()
    first = marked.where("url = 1").first()
    assert first.letter_done == "Ja" and first.file_name == "Bewerbung_Fa_1_Chef"
    mails = {r.url: r for r in selection.outbox(marked, "N", "out", "cv.pdf", "ref.pdf").collect()}
    assert set(mails) == {1, 2}
    assert mails[1].subject == "Bewerbung als Chef" and mails[1].letter_path == "out/Bewerbung_Fa_1_Chef.pdf"
    assert mails[1].body.endswith("\nmit freundlichen Grüßen,\nN")
    sent = {r.url: r.sent for r in selection.mark_sent(marked).collect()}
    assert sent == {1: "Ja", 2: "Ja", 3: None, 4: None, 5: "Ja", 6: None}


def test_letter_texts(spark):
    df = spark.createDataFrame([("Analyst", "Fa", ["Weg 1", "Ort"]), (None, None, None)], "title string, company string, address array<string>")
    texts = selection.letter_texts("Ich.", "01.01.2025", "Ort", F.to_date(F.lit("2025-03-09")))
    row, empty = df.select(*texts).collect()
    assert row.place_date == "Ort, den 09.03.2025" and row.address_block == "Weg 1\nOrt\n"
    assert row.subject_line == "Bewerbung um die Stelle als Analyst" and empty.address_block == "\n\n"
    assert row.closing.startswith("Ich. Mein") and "{" not in row.closing + row.intro


def test_prompt(spark):
    text = spark.range(1).select(selection.prompt_text(F.lit("A"), F.lit("B"), F.lit(None)).alias("p")).first().p
    assert text.startswith("create a text in german") and text.endswith("130 words: ")


def brute_language(train, texts):
    import math
    from collections import Counter

    def grams(t):
        return [t[i : i + 3] for i in range(len(t) - 2)]

    counts = {}
    for lang, t in train:
        counts.setdefault(lang, Counter()).update(grams(t))
    known = set().union(*counts.values())
    out = []
    for t in texts:
        seen = [g for g in grams(t) if g in known]
        score = {
            lang: sum(math.log((c[g] + 1) / (sum(c.values()) + len(known))) for g in seen) for lang, c in counts.items()
        }
        out.append(min(score, key=lambda lang: (-score[lang], lang)) if seen else None)
    return out


def test_language_on_both_join_paths(spark):
    train = [("de", "der hund und die katze"), ("en", "the dog and the cat"), ("de", "das ist gut"), ("en", "this is good"), (None, "quoi")]
    texts = ["die katze ist gut", "the cat is good", "xyz", "", "the der", "quoi"]
    df = spark.createDataFrame(train, "lang string, text string")
    model = language.language_model(df)
    assert set(model.columns) == {"gram", "lang", "log"}
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id bigint, text string")
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = {r.id: r.detected for r in language.detect_language(docs, "id", model).collect()}
        assert [got[i] for i in range(len(texts))] == brute_language([t for t in train if t[0]], texts)
        assert got[99] is None
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_language_by_either_path_and_any_number_of_languages(spark, monkeypatch):
    """Codes beyond the basic plane, more languages than share a row, and a model too large for a broadcast."""
    train = [(f"l{k:02d}", "the same" + f" {chr(0x1F600 + k)}{chr(228 + k)}x" * (1 + k % 3)) for k in range(19)]
    texts = [t for _, t in train] + ["same the", "zz", "qqqq", chr(0x1F600) + chr(228) + "x the"]
    model = language.language_model(spark.createDataFrame(train, "lang string, text string"))
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id bigint, text string")
    for small in (True, False):
        monkeypatch.setattr(language, "is_small", lambda df, small=small: small)
        got = {r.id: r.detected for r in language.detect_language(docs, "id", model).collect()}
        assert [got[i] for i in range(len(texts))] == brute_language(train, texts)
        assert got[99] is None


def test_language_cuts_trigrams_without_a_pattern_search(spark):
    model = language.language_model(spark.createDataFrame([("de", "der hund")], "lang string, text string"))
    docs = spark.createDataFrame([(1, "der hund")], "id bigint, text string")
    plan = language.detect_language(docs, "id", model)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "sort_array" not in plan and "SortMergeJoin" not in plan


def test_language_of_rows_that_the_model_has_not_seen(spark):
    """Fitted on some of the documents, right on nearly all of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200")
    model = language.language_model(docs.where("doc_id % 4 <> 2"))
    unseen = docs.where("doc_id % 4 = 2")
    found = language.detect_language(unseen, "doc_id", model).join(unseen, "doc_id")
    total, right = found.count(), found.where("detected = lang").count()
    assert total > 100 and right >= 0.98 * total


def test_language_text(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "parts array<string>")
    assert [r.t for r in df.select(cleaning.language_text(F.col("parts")).alias("t")).collect()] == ["a b", "a", ""]
