import re

from pyspark.sql import functions as F

from lexfit.functions import html as H
from lexfit.functions import records as R
from lexfit.operators import pages


def one(spark, html, expression, name="html"):
    df = spark.createDataFrame([(html,)], f"{name} string")
    return df.repartition(1).select(expression.alias("y")).first().y


#: Pages and the parts that a reader sees in them.
LAYOUTS = {
    "intro<h4 class=x>A</h4><p>text <b>bold</b></p><h4>B</h4>  <h4>C</h4>end": ["intro", "A", "text bold", "B", "C", "end"],
    "<h2>A</h2>one two<h2>B</h2>": ["A", "one two", "B"],
    "<p>no heading</p> at all": ["no heading at all"],
    "<h4>broken\nline</h4>x<h4>ok</h4>y": ["broken line x", "ok", "y"],
    "a < b <h4>x</h4> c > d": ["a < b", "x", "c > d"],
    "<h2>two</h2><h4>four</h4>rest": ["two", "four", "rest"],
    "": [],
}


def test_parts(spark):
    for html, want in LAYOUTS.items():
        assert one(spark, html, H.page_parts(F.col("html"))) == want, html


def test_heading_split_keeps_headings(spark):
    got = one(spark, "a<h4 class=x>A</h4>b<h4>B</h4>", H.heading_split(F.col("html")))
    assert got == ["a", "<h4 class=x>A</h4>", "b", "<h4>B</h4>", ""]


def test_drop_intro(spark):
    many = "intro" + "<h4>x</h4>y" * 5
    few = "intro" + "<h4>x</h4>y" * 4
    for html, want in ((many, ["x", "y"] * 5), (few, ["intro"] + ["x", "y"] * 4)):
        assert one(spark, html, H.drop_intro(H.page_parts(F.col("html")), F.col("html"))) == want


def test_part_columns(spark):
    df = spark.createDataFrame([(["a", "b"],)], "parts array<string>")
    assert tuple(df.select(*H.part_columns(F.col("parts"), 4)).first()) == ("a", "b", "", "", 2, [])
    assert tuple(df.select(*H.part_columns(F.col("parts"), 1)).first()) == ("a", 2, ["b"])


def test_links(spark):
    html = """<a href="/a?x=1">1</a><a href='https://logo'>l</a><a href=/b>2</a>"""
    assert one(spark, html, H.links(F.col("html"), "https://base")) == ["https://base/a?x=1", "https://base/b"]


def test_between_is_split_element_one(spark):
    for html in ("x<t>mid</t>y", "<t>open", "y</t>z<t>w", "none"):
        pieces = re.split("<t>|</t>", html)
        want = pieces[1] if len(pieces) > 1 else None
        assert one(spark, html, H.between(F.col("html"), ("<t>", "</t>"))) == want


def test_address_from_facts(spark):
    facts = {
        "<b>Fakten</b> Musterweg 1, 20095 Hamburg, Unternehmensgröße: 50 , x": ["Musterweg 1", "20095 Hamburg"],
        "Weg 2, Unternehmensgröße: a DEUnternehmensgröße: b": ["Weg 2", "Unternehmensgröße: a"],
        "FaktenX https://a.de Weg 3,, Ort , ": ["Weg 3", "Ort"],
        "": [],
    }
    for html, want in facts.items():
        assert one(spark, html, H.address_from_facts(F.col("html"))) == want, html


def test_address_items_and_lines(spark):
    assert one(spark, " Weg 1 , Ort, Deutschland", H.address_items(F.col("html"))) == ["Weg 1", "Ort"]
    assert one(spark, "Deutschland", H.address_items(F.col("html"))) == []
    lines = R.address_lines(F.split("html", ","))
    assert one(spark, "Weg 1, Ort", lines) == "Weg 1\nOrt\n"
    assert one(spark, None, lines) == "\n\n"
    assert one(spark, "Deutschland", R.address_lines(H.address_items(F.col("html")))) == "\n\n"


def test_replacements_by_place_keep_all_parts(spark):
    parts = ["a&nbsp;amp;b\n"] * 12
    df = spark.createDataFrame([(parts,)], "parts array<string>")
    got = df.select(R.replace_parts(F.col("parts"))).first()[0]
    assert len(got) == 12 and got[2] == "a b " and got[1] == parts[1] and got[8] == "a b\n" and got[11] == parts[11]


def test_address_resolve(spark):
    ads = spark.createDataFrame(
        [(0, "<loc>Weg 1, Ort, DE</loc>"), (1, "card <a class=c href='/firm'>x</a>"), (2, "card <a href='/none'>"), (3, "nothing")]
        + [(i, "card <a href='/firm'>") for i in range(10, 60)],
        "page_id bigint, html string",
    )
    firms = spark.createDataFrame([("/firm", "<f2>Fakten Platz 2, Stadt</f2>")], "link string, html string")
    out = pages.address_resolve(ads, firms, "<loc>(.+?)</loc>", card_marker="card", facts_patterns=["<f1>(.+?)</f1>", "<f2>(.+?)</f2>"])
    got = {r.page_id: r.address for r in out.collect()}
    assert got[0] == ["Weg 1", "Ort"] and got[1] == ["Platz 2", "Stadt"]
    assert got[2] == [] and got[3] == [] and len(got) == 54
    assert all(got[i] == ["Platz 2", "Stadt"] for i in range(10, 60))


def test_links_per_page_keeps_empty_pages(spark):
    df = spark.createDataFrame([(1, "<a href=/a>"), (2, "none")], "page_id bigint, html string")
    assert {tuple(r) for r in pages.links_per_page(df, "").collect()} == {(1, 1), (2, 0)}
    assert pages.top_n_per_page(df, "", 3).count() == 1


def test_search_plan(spark):
    terms = spark.createDataFrame([("data-analyst",)], "term string")
    rows = pages.search_plan(terms, 2, F.lit("20095"), F.lit("30"), "https://x").orderBy("page").collect()
    assert [r.page for r in rows] == [1, 2]
    assert rows[0].request_url == (
        "https://x/jobs/data-analyst/in-20095?radius=30&page=1"
        "&action=facet_selected%3bapplicationMethod%3bINTERNAL&am=INTERNAL"
    )
