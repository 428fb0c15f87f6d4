import random
import re

import pytest
from pyspark.sql import functions as F

from lexfit.operators import scoring
from lexfit.operators.joins import value_filter
from lexfit.operators.terms import drop_listed_tokens, lemmatize, prepare_terms
from lexfit.plans import report

from . import plain

WORDS = "daten analyse sql excel team a b büro prozess report".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    return texts + ["", "a b a", "fremd"]


TERMS = {"tasks": ["daten", "sql", "daten", "a", "nirgends"], "profile": ["excel", "team"]}


def frames(spark, corpus):
    texts = spark.createDataFrame(
        [(i, s, t) for i, t in enumerate(corpus) for s in TERMS], "id bigint, section string, text string"
    )
    terms = spark.createDataFrame(
        [(s, i, 0, t) for s, ts in TERMS.items() for i, t in enumerate(ts)],
        "section string, pos bigint, sub_pos int, term string",
    )
    return texts, terms


def scored(spark, corpus):
    texts, terms = frames(spark, corpus)
    profiles = scoring.term_profiles(terms)
    features = scoring.score_features(texts, ["id"], profiles).cache()
    out = scoring.matched(scoring.jaccard(scoring.cosine(features, profiles)))
    return {(r.id, r.section): r for r in out.collect()}


def test_scores_against_brute_force(spark, corpus):
    got = scored(spark, corpus)
    for section, query in TERMS.items():
        cosines = plain.cosine(query, corpus)
        for i, text in enumerate(corpus):
            row = got[i, section]
            assert row.cosine == pytest.approx(cosines[i], abs=1e-11)
            assert row.jaccard == pytest.approx(plain.jaccard(text.split(), query), abs=1e-11)
            words = [t for t in query if t in text.split()]
            assert row.matched == (" ".join(words) if cosines[i] else None)


def test_score_properties(spark, corpus):
    for row in scored(spark, corpus).values():
        assert 0 <= row.cosine <= 1 and 0 <= row.jaccard <= 1
    # One-letter words count for matches and Jaccard, not for the cosine.
    got = scored(spark, corpus)[61, "tasks"]
    assert got.cosine == 0 and got.matched is None and got.jaccard == pytest.approx(1 / 5)


def test_text_against_itself(spark):
    text = "daten daten sql team"
    texts = spark.createDataFrame([(1, "tasks", text)], "id bigint, section string, text string")
    terms = spark.createDataFrame([("tasks", i, 0, t) for i, t in enumerate(text.split())], "section string, pos bigint, sub_pos int, term string")
    profiles = scoring.term_profiles(terms)
    row = scoring.jaccard(scoring.cosine(scoring.score_features(texts, ["id"], profiles), profiles)).first()
    assert row.cosine == 1.0 and row.jaccard == 1.0 and row.dot == 6


def test_empty_vocabulary(spark):
    texts = spark.createDataFrame([(1, "tasks", "")], "id bigint, section string, text string")
    _, terms = frames(spark, [])
    profiles = scoring.term_profiles(terms)
    row = scoring.cosine(scoring.score_features(texts, ["id"], profiles), profiles).first()
    assert row.cosine == 0.0


def test_term_counts_and_vocabulary(spark, corpus):
    from collections import Counter

    texts, terms = frames(spark, corpus)
    counted = scoring.term_counts(texts.where("section = 'tasks'"), "id").collect()
    want = {(i, w): n for i, t in enumerate(corpus) for w, n in Counter(w for w in t.split() if len(w) > 1).items()}
    assert {(r.id, r.token): r.tf for r in counted} == want
    known = scoring.corpus_vocabulary(texts, terms).collect()
    assert sorted(r.term for r in known if r.section == "tasks") == ["daten", "daten", "sql"]


def test_section_without_terms_keeps_its_rows(spark, corpus):
    texts, terms = frames(spark, corpus)
    profiles = scoring.term_profiles(terms.where("section = 'tasks'"))
    out = scoring.jaccard(scoring.cosine(scoring.score_features(texts, ["id"], profiles), profiles))
    rows = [r for r in scoring.matched(out).collect() if r.section == "profile"]
    assert len(rows) == len(corpus)
    assert all(r.cosine == 0 and r.jaccard in (0, None) and r.matched is None for r in rows)


def test_fifty_thousand_terms(spark):
    many = spark.range(50_000).selectExpr("'tasks' AS section", "id AS pos", "0 AS sub_pos", "concat('wort', id) AS term")
    texts = spark.createDataFrame([(1, "tasks", "wort7 wort49999 anders wort7")], "id bigint, section string, text string")
    profiles = scoring.term_profiles(many)
    features = scoring.score_features(texts, ["id"], profiles)
    row = scoring.matched(scoring.jaccard(scoring.cosine(features, profiles))).first()
    assert row.dot == 3 and row.matched == "wort7 wort49999" and row.n_union == 50_001
    assert row.cosine == pytest.approx(3 / (6**0.5 * 2**0.5))


def test_total_needs_every_part(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.4), (0.2, None, 0.4)], "tasks_j double, profile_j double, benefits_j double")
    got = [r.t for r in df.select(scoring.total_score(suffix="_j").alias("t")).collect()]
    assert got[0] == pytest.approx(0.8) and got[1] is None


def test_prepare_terms(spark):
    rows = [("tasks", i, t) for i, t in enumerate(["ms office", "it-affinität", "Prozesse", "!?", "", None, "Prozesse"])]
    terms = spark.createDataFrame(rows, "section string, pos bigint, term string")
    got = {r.pos: r.term for r in prepare_terms(terms).collect()}
    word = plain.cistem(plain.snowball("prozesse"))
    assert got == {0: "ms", 1: "it", 2: word, 6: word}
    split = [(r.pos, r.sub_pos, r.term) for r in prepare_terms(terms, stem=False, split_phrases=True).collect()]
    assert (0, 0, "ms") in split and (0, 1, "office") in split
    lemmas = spark.createDataFrame([("prozesse", "prozess")], "token string, lemma string")
    got = {r.pos: r.term for r in prepare_terms(terms, lemmas, stem=False).collect()}
    assert got[2] == "prozess" and got[0] == "ms"


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_dictionary_steps_on_both_join_paths(spark, corpus, threshold):
    long = " ".join(random.Random(5).choice(WORDS) for _ in range(5000))
    corpus = [*corpus, long, " leading", "daten  daten ", None]
    texts = spark.createDataFrame(list(enumerate(corpus)), "id bigint, text string")
    pairs = [("daten", "datum"), ("sql", "abfrage"), ("zzz", "y"), ("büro", "amt"), ("büro", "kontor"), (None, "x"), ("team", None)]
    lemmas = spark.createDataFrame(pairs, "token string, lemma string")
    listed = {"daten": "datum", "sql": "abfrage", "büro": "amt"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        done = lemmatize(texts, "id", "text", lemmas)
        got = {r.id: r.text for r in done.collect()}
        assert got == {i: None if t is None else " ".join(listed.get(w, w) for w in t.split(" ")) for i, t in enumerate(corpus)}
        stop = spark.createDataFrame([("daten",), ("a",), ("a",)], "token string")
        got = {r.id: r.text for r in drop_listed_tokens(texts, "id", "text", stop).collect()}
        assert got == {i: None if t is None else " ".join(w for w in t.split(" ") if w not in ("daten", "a")) for i, t in enumerate(corpus)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if threshold == "10m":
        text = lemmatize(texts, "id", "text", lemmas)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert len(re.findall(r"Exchange hashpartitioning\(id", text)) == 1


def test_dictionary_work_per_text_is_linear(spark):
    """Tokens that are not listed are left out before the sort; no step goes through the whole array per token."""
    words = [f"w{i}" for i in range(20000)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "kein eintrag"), (3, "w0 w1 w0 eins")], "id bigint, text string")
    lemmas = spark.createDataFrame([(w, "x") for w in words if w.endswith("1")], "token string, lemma string")
    done = lemmatize(texts, "id", "text", lemmas)
    got = {r.id: r.text for r in done.collect()}
    assert got == {1: " ".join("x" if w.endswith("1") else w for w in words), 2: "kein eintrag", 3: "w0 x w0 eins"}
    text = done._jdf.queryExecution().executedPlan().toString()
    assert "slice(" not in text and "sort_array(filter(" in text


def test_real_lemma_pairs(spark):
    """Inflected German forms; a token that is no entry stays as it is."""
    pairs = [("berichte", "bericht"), ("berichten", "bericht"), ("analysierte", "analysieren"), ("ging", "gehen"), ("häuser", "haus")]
    lemmas = spark.createDataFrame(pairs, "token string, lemma string")
    texts = spark.createDataFrame([(1, "er analysierte die berichte und ging"), (2, "häuser häuser berichten")], "id bigint, text string")
    got = {r.id: r.text for r in lemmatize(texts, "id", "text", lemmas).collect()}
    assert got == {1: "er analysieren die bericht und gehen", 2: "haus haus bericht"}


def test_report_on_ads(spark):
    ads = [
        ("https://x/1234567-inline.html", "Analyst (m/w/d)", ["Aufgaben", "Daten analysieren und Berichte", "Profil", "SQL Python", "Wir bieten", "Gleitzeit", "", "", "an a@b.de"]),
        ("https://x/7654321-inline.html", "Koch", ["Aufgaben", "Kochen", "Profil", "Messer"]),
        ("https://x/0000001-inline.html", "Werkstudent", ["Aufgaben", "Daten"]),
    ]
    records = spark.createDataFrame(ads, "url string, title string, parts array<string>")
    prepared = {r.url[10:17]: r for r in report.prepare_records(records).collect()}
    assert set(prepared) == {"1234567", "7654321"}
    assert prepared["1234567"].job_id == "1234567" and prepared["1234567"].email == "a@b.de"
    assert prepared["1234567"].title == "Analyst" and prepared["7654321"].benefits == "leer"
    rows = {r.url[10:17]: r for r in report.fit_report(records, report.default_terms(spark)).collect()}
    good, poor = rows["1234567"], rows["7654321"]
    assert good.tasks_jaccard > 0 and poor.tasks_jaccard == 0 and good.tasks_jaccard_rank == 1
    # "daten" and "daten-muster" share their first word: repeats are kept.
    assert good.tasks_matched == "dat dat" and poor.tasks_matched is None
    assert good.total_jaccard == pytest.approx(good.tasks_jaccard + good.profile_jaccard + good.benefits_jaccard / 2)


def test_report_with_lemmas(spark):
    records = spark.createDataFrame(
        [("u1", "t", ["Aufgaben", "Berichte lesen"]), ("u2", "t", ["Aufgaben", "nichts"])],
        "url string, title string, parts array<string>",
    )
    lemmas = spark.createDataFrame([("berichte", "report")], "token string, lemma string")
    terms = spark.createDataFrame([("tasks", 0, "report")] + [(s, 0, "x") for s in ("profile", "benefits")], "section string, pos bigint, term string")
    rows = {r.url: r for r in report.fit_report(records, terms, lemmas=lemmas).collect()}
    assert rows["u1"].tasks_cosine > 0 and rows["u2"].tasks_cosine == 0


def test_rescoring_from_features_equals_a_full_run(spark, corpus):
    """Features of two batches, put together, give the scores of one run over both."""
    rows = [(str(i), s, t) for i, t in enumerate(corpus) for s in TERMS]
    texts = spark.createDataFrame(rows, "url string, section string, text string")
    profiles = scoring.term_profiles(frames(spark, [])[1])
    first, second = texts.where("int(url) < 20"), texts.where("int(url) >= 20")
    parts = report.section_features(first, profiles).union(report.section_features(second, profiles))
    at_once = report.scores(report.section_features(texts, profiles), profiles)
    assert sorted(map(tuple, report.scores(parts, profiles).collect()), key=str) == sorted(map(tuple, at_once.collect()), key=str)


def test_full_store(spark):
    from lexfit.operators.language import language_model
    from lexfit.operators.selection import mark_done, eligible
    from lexfit.schemas import STORE

    rows = [
        ("https://x/1234567-inline.html", "Analyst (m/w/d)", "Fa", ["Weg 1"], ["Aufgaben", "Die Daten und Berichte", "Profil", "SQL"], 0, 1),
        ("https://x/7654321-inline.html", "Cook", "Fb", None, ["Tasks", "the cooking and the food"], 0, 2),
    ]
    records = spark.createDataFrame(rows, "url string, title string, company string, address array<string>, parts array<string>, batch_no bigint, pos bigint")
    model = language_model(spark.createDataFrame([("de", "die aufgaben und berichte"), ("en", "the tasks and cooking")], "lang string, text string"))
    store = report.full_store(records, report.default_terms(spark), ["und"], language_model=model)
    assert store.schema.names == STORE.names
    got = {r.company: r for r in mark_done(store, eligible()).collect()}
    a, b = got["Fa"], got["Fb"]
    assert a.tasks == "Die Daten und Berichte" and a.tasks_clean == ["die", "daten", "und", "berichte"]
    assert a.tasks_stem1 == [plain.snowball(w) for w in a.tasks_clean]
    assert a.tasks_stem2 == [plain.cistem(w) for w in a.tasks_stem1]
    assert a.tasks_no_stop == [w for w in a.tasks_stem2 if w != "und"] and a.tasks_joined == " ".join(a.tasks_no_stop)
    assert (a.lang, b.lang) == ("de", "en") and a.tasks_matched.split()[0] == "dat"
    assert a.letter_done == "Ja" and b.letter_done is None and b.profile == "leer"
    assert a.tasks_jaccard_rank == 1 and b.tasks_jaccard_rank == 2 and a.tasks_rank_diff == 0


def test_query_filter_holds_back_what_the_query_cannot_hold(spark):
    query = spark.range(50_000).selectExpr("concat('wort', id) AS token")
    tokens = spark.range(200_000).selectExpr("id", "concat('wort', id) AS token")
    passed = tokens.where(value_filter(query, "token")(F.col("token")))
    assert passed.where("id < 50000").count() == 50_000
    assert passed.where("id >= 50000").count() < 12_000


def test_one_text_under_several_sections(spark, corpus):
    texts, terms = frames(spark, corpus)
    profiles = scoring.term_profiles(terms)
    once = texts.where("section = 'tasks'").select("id", "text")
    long = scoring.jaccard(scoring.cosine(scoring.score_features(texts, ["id"], profiles), profiles))
    wide = scoring.score_features(once, ["id"], profiles, sections=list(TERMS))
    wide = scoring.jaccard(scoring.cosine(wide, profiles))
    values = ["id", "section", "cosine", "jaccard", "square"]
    assert sorted(map(tuple, wide.select(*values).collect())) == sorted(map(tuple, long.select(*values).collect()))
    known = [scoring.corpus_vocabulary(x, terms, sections=s).collect() for x, s in ((texts, None), (once, list(TERMS)))]
    assert sorted(known[0]) == sorted(known[1])
    without = scoring.jaccard(scoring.score_features(once, ["id"], profiles, sections=list(TERMS), vectors=False))
    assert sorted(map(tuple, without.select("id", "section", "jaccard").collect())) == sorted((r.id, r.section, r.jaccard) for r in wide.collect())
    assert "square" not in without.columns


def test_page_letters(spark):
    """Chosen rows only, with the company page's address where the ad has none, and replacements made."""
    from lexfit.operators import pages, selection

    def ad(title, body, address=""):
        return f"<h1>{title}</h1><b>Fa &amp; Co</b>{address}<a href='/firm'>card</a><h4>Aufgaben</h4><p>{body}</p><h4>Profil</h4><p>SQL</p>"

    rows = [
        (1, "https://x/1234567-inline.html", ad("Analyst &amp; Co (m/w/d)", "Die Daten und Berichte")),
        (2, "https://x/1234568-inline.html", ad("Analyst", "Daten und Berichte", "<i>Weg 1, Ort, DE</i>")),
        (3, "https://x/1234569-inline.html", ad("Cook", "the cooking and the food")),
        (4, "https://x/1234570-inline.html", "no ad"),
    ]
    landed = spark.createDataFrame(rows, "page_id long, url string, html string")
    firms = spark.createDataFrame([("/firm", "<f>Fakten Platz 2, Stadt</f>")], "link string, html string")
    options = {"company_markers": ("<b>", "</b>"), "title_markers": ("<h1>", "</h1>"), "tags": ["h4"], "address_pattern": "<i>(.+?)</i>"}
    store = pages.page_records(landed, **options)
    texts = selection.letter_texts("Hi.", "01.02.2025", "Hamburg", F.to_date(F.lit("2025-01-02")))
    where = {"address_pattern": "<i>(.+?)</i>", "card_marker": "card", "facts_patterns": ["<f>(.+?)</f>"], "card_pattern": "href='([^']+)"}
    terms = spark.createDataFrame([("tasks", 0, "Daten"), ("profile", 0, "SQL")], "section string, pos int, term string")
    limits = {"tasks": 0.2, "profile": 0.2, "benefits": 0.0, "total": 1.2}
    out = report.page_letters(store, landed, firms, terms, texts, limits, stop_words=["und", "die"], **where)
    got = {r.url[10:17]: r for r in out.collect()}
    assert set(got) == {"1234567", "1234568"}
    assert (got["1234567"].title, got["1234567"].company) == ("Analyst & Co", "Fa & Co")
    assert got["1234567"].address_block == "Platz 2\nStadt\n" and got["1234568"].address_block == "Weg 1\nOrt\n"
    assert got["1234567"].tasks_jaccard == 0.5 and got["1234567"].profile_jaccard == 1.0
    assert report.page_letters(store.limit(0), landed, firms, terms, texts, limits, **where).count() == 0


def test_words_of_a_text_are_worked_out_once(spark):
    """Not once more for each place that they have in a generator's argument."""
    terms = spark.createDataFrame([("tasks", 0, 0, "kochen")], "section string, pos bigint, sub_pos int, term string")
    texts = spark.createDataFrame([(1, "kochen und backen")], "id bigint, text string")
    features = scoring.score_features(texts, ["id"], scoring.term_profiles(terms), sections=["tasks", "profile", "benefits"])
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_distinct(") == 1, plan
