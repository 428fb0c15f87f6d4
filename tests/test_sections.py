import random

from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.operators import sections as S

from . import plain

K = fx.SECTION_KEYWORDS


def rows():
    rng = random.Random(11)
    words = (
        "Deine Aufgaben|Was dich bei uns erwartet|Dein Profil|Wir bieten|Darum|Benefits|Zusätzliche Informationen|"
        "Kontakt|Werde ein Teil|Was Sie erwarten kannst|x|Überblick|" + "lang " * 30 + "Aufgaben|fürAufgaben|jobs to do"
    ).split("|")
    out = [[rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(400)]
    return out + [["Aufgaben"], ["x" * 100], [], ["Zusätzliche Informationen", "a", "Zusätzliche Informationen", "Unsere Benefits"]]


def check(spark, expression, want):
    data = rows()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(data)], "i int, parts array<string>")
    got = {r.i: r.y for r in df.select("i", expression.alias("y")).collect()}
    for i, parts in enumerate(data):
        assert got[i] == want(parts), parts


def test_tasks(spark):
    check(spark, S.section_tasks(F.col("parts")), lambda p: plain.section(p, K["tasks", 1], guarded={0: K["tasks", 2], 1: K["tasks", 2]}))


def test_profile(spark):
    check(spark, S.section_profile(F.col("parts")), lambda p: plain.section(p, K["profile", 1]))


def test_benefits(spark):
    check(
        spark, S.section_benefits(F.col("parts")),
        lambda p: plain.section(p, K["benefits", 1], 1, {5: K["benefits", 2]}, K["benefits", 3]),
    )


def test_contact(spark):
    check(spark, S.section_contact(F.col("parts")), lambda p: plain.section(p, K["contact", 1], 5, sentinel=None))


def test_walk_through_record_fields(spark):
    rows = [
        ("1234567", "u", "Aufgaben und mehr", "Firma", ["Intro", "Text"], "Firma"),  # a heading among the fields
        ("1", "u", "Titel", "Aufgaben", ["Text"], "Text"),  # the last field: the first part follows
        ("1", None, "Titel", "Firma", ["erwartet dich", "Das"], "Das"),  # position of the first part
        ("1", None, "erwartet dich", "Firma", ["x", "y"], "leer"),  # does not count among the fields
    ]
    df = spark.createDataFrame(rows, "job_id string, url string, title string, company string, parts array<string>, want string")
    cells = S.scan_cells(F.col("parts"), *[F.col(c) for c in ("job_id", "url", "title", "company")])
    for r in df.select("want", S.section_tasks(cells, fields=4).alias("got")).collect():
        assert r.got == r.want
    late = spark.createDataFrame([(["a", "b", "c", "d", "e", "Kontakt", "hier"],)], "parts array<string>")
    cells = S.scan_cells(F.col("parts"), F.lit("Kontakt"))
    assert late.select(S.section_contact(cells, fields=1).alias("got")).first().got == "hier"
    assert late.select(S.section_contact(S.scan_cells(F.col("parts"))).alias("got")).first().got == "hier"
