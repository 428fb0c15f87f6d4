import random

import pytest
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import records as R
from lexfit.functions import text as T
from lexfit.functions.stemming import cistem, snowball_german
from lexfit.operators.terms import stem_dictionary, stem_text, vocabulary

from . import plain

TEXTS = [
    "Größe & Maß – für uns!\nNeu: ÄÖÜ, ß?",
    "a•b –c d e\x1cf  _g_",
    "zwei\n\nZeilen ohne Lücke",
    "é ² ½ Ⅷ 東京",
    "",
    "  nur   Leer \t zeichen ",
    "ẞ Straße İ",
]


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.repartition(3).select("i", expression.alias("y")).orderBy("i").select("y").collect()]


def test_clean_text_and_tokens(spark):
    assert column(spark, TEXTS, T.clean_text(F.col("x"))) == [plain.clean(t) for t in TEXTS]
    got = column(spark, TEXTS, T.tokenize(T.clean_text(F.col("x"))))
    assert got == [plain.clean(t).split() for t in TEXTS]
    assert column(spark, [None], T.clean_text(F.col("x"))) == [None]


def test_newline_option(spark):
    assert column(spark, ["a\nb"], T.clean_text(F.col("x"))) == ["ab"]
    assert column(spark, ["a\nb"], T.clean_text(F.col("x"), newline_as_space=True)) == ["a b"]


def test_strip_all_whitespace(spark):
    texts = ["  a b\x1f\n", "\n\n", "x"]
    assert column(spark, texts, T.strip(F.col("x"))) == [t.strip() for t in texts]


def test_vectorizer_tokens(spark):
    got = column(spark, ["Für a b12 x_y é"], T.vectorizer_tokens(F.col("x")))
    assert got == [["für", "b12", "x_y"]]


def test_char_trigrams(spark):
    texts = ["abcd", "ab", "a\nb😀c"]
    want = [[t[i : i + 3] for i in range(len(t) - 2)] for t in texts]
    assert column(spark, texts, T.char_trigrams(F.col("x"))) == want


def test_emails(spark):
    import re

    texts = ["a.b@c.de und x+y@z-1.org.", "kein", "éabc@x.de .q@r.st", "a@b.c|d", "m@n.co_"]
    pattern = r"\b" + fx.EMAIL_PATTERN + r"\b"
    want = [",".join(re.findall(pattern, t)) for t in texts]
    assert column(spark, texts, T.extract_emails(F.col("x"))) == want


def test_stop_words(spark):
    kept = T.remove_stopwords(F.split("x", " "), ["der", "a"])
    assert column(spark, ["der hund der a hund b"], kept) == [["hund", "hund", "b"]]


@pytest.mark.parametrize("n", [0, 5, 12, 13, 18, 19, 26])
def test_job_id(spark, n):
    url = "abcdefghijklmnopqrstuvwxyz"[:n]
    assert column(spark, [url], R.job_id(F.col("x"))) == [url[-19:-12]]


def test_title_clean(spark):
    titles = [f"Data {m} Analyst {m}" for m in fx.GENDER_MARKERS] + ["x", " (m/w/d) ", None]
    want = []
    for t in titles:
        for m in sorted(fx.GENDER_MARKERS, key=len, reverse=True):
            t = t.replace(m, "") if t else t
        want.append(t.strip() if t is not None else None)
    assert column(spark, titles, R.title_clean(F.col("x"))) == want


def test_title_blocked(spark):
    titles = ["Werkstudentin", "AUSSENDIENST", "Mitarbeiter AUßENDIENST", None, "Analyst"]
    assert column(spark, titles, R.title_blocked(F.col("x"))) == [True, False, True, False, False]


def test_replacements_in_order(spark):
    df = spark.createDataFrame([("&amp;nbsp;x\ny", "amp;", "Chevron bottom icon amp;")], "part_1 string, part_5 string, part_9 string")
    row = df.select(*[R.replace_multi(c) for c in df.columns]).first()
    assert tuple(row) == (" x y", "amp;", "  ")


def test_file_name_and_tidy(spark):
    name = R.safe_file_name(F.lit("A/B:C"), F.lit('x<y>*?"\\|z'), prefix="P_")
    assert column(spark, ["-"], name) == ["P_A_B_C_x_y______z"]
    assert column(spark, [" a\n\nb\n\n"], T.tidy_text(F.col("x"))) == ["a b"]


def word_sample(n, seed=3):
    pieces = (
        "ge sch ein nis niss e en er ern em es s st est end ung ig ik isch lich heit keit a u y "
        "ä ü au b l t rr nd ei ie ö ß k é 1"
    ).split()
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(n)})


def test_stemmers_match_the_rules(spark):
    words = word_sample(30000) + ["aufgaben", "prozesse", "datenanalyse", "mitarbeiterin", "ergebnisse"]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
    got = column(spark, texts, snowball_german(F.col("x")))
    assert " ".join(got).split(" ") == [plain.snowball(w) for w in words]
    got = column(spark, texts, cistem(F.col("x")))
    assert " ".join(got).split(" ") == [plain.cistem(w) for w in words]


def test_stems_count_letters_beyond_the_basic_plane(spark):
    words = ["7xq\U0001d49cnd", "bs\U0001d49cern", "en\U0001d49cmmerlich", "\U0001d49c\U0001d49cs", "\U0001d49cb\U0001d49cs", "\U0001d49cabigkeit"]
    text = [" " + " ".join(words) + "  ", None]
    for stemmer, rule in ((snowball_german, plain.snowball), (cistem, plain.cistem)):
        assert column(spark, text, stemmer(F.col("x"))) == [" ".join(rule(w) for w in words) + "  ", None]


def test_known_stems(spark):
    pairs = {"aufeinanderfolgenden": "aufeinanderfolg", "kategorische": "kategor", "häuser": "haus", "verständnisse": "verstandnis"}
    assert column(spark, list(pairs), snowball_german(F.col("x"))) == list(pairs.values())


def test_long_runs_do_not_overflow(spark):
    text = "n" * 50000 + "x " + "en" * 50000
    got = column(spark, [text], stem_text(F.col("x")))[0].split(" ")
    assert got[0] == "n" * 50000 + "x" and len(got[1]) < 10


def test_dictionary_equals_stemming_in_place(spark):
    words = word_sample(2000, seed=5)
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words[::2]),)], "text string")
    stems = {r.token: r.stem2 for r in stem_dictionary(vocabulary(df, "text")).collect()}
    direct = df.select(stem_text(F.col("text")).alias("t")).first().t.split(" ")
    assert direct == [stems[w] for w in words]
