"""Quality, language and personal data against plain Python and held-out rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfit.llm import langid, pii, quality_gam, quality_rules
from lexfit.llm.common import lookup
from lexfit.session import stage

WORDS = {
    "en": "the and of thing water house being street letter under".split(),
    "de": "der und schön straße zwischen mädchen über größe nicht ein".split(),
    "fr": "le été très garçon français où leçon être cœur beaucoup".split(),
}


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def junk(rng, n=60):
    return " ".join(rng.choice(WORDS["en"]) + rng.choice(["###", "&&&", "%%%"]) for _ in range(n))


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(1)
    marks = [int(rng.random() < 0.7) for _ in range(240)]
    docs = make([prose(rng) if m else junk(rng) for m in marks])
    labels = spark.createDataFrame([(i, m, 0, "x") for i, m in enumerate(marks)] + [(None, 1, 0, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels, marks


def test_quality_separates_held_out_rows(labelled):
    docs, labels, marks = labelled
    rows = quality_gam.apply(docs, labels).collect()
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and all(r.predicted == marks[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_awkward_texts(labelled, make, awkward, spark):
    _, labels, _ = labelled
    rows = quality_gam.apply(make(awkward, ids=[None, *range(1, len(awkward))]), labels).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    nothing = quality_gam.apply(make(awkward), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {1.0}
    assert quality_gam.apply(make([]), labels).count() == 0


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, n_pairs=1)
    assert sorted(model.pairs[0]) == [0, 1]
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_language_held_out_and_unknown(make, awkward):
    rng = random.Random(2)
    langs = [rng.choice(list(WORDS)) for _ in range(240)]
    texts = [prose(rng, lang, 30) for lang in langs]
    rows = langid.apply(make(texts + ["123 ...", None], langs=[*langs, "en", None])).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id >= 240} == {("und", 0.0)}
    odd = langid.apply(make(awkward, langs=[None] * len(awkward))).collect()
    assert len(odd) == len(awkward) and {r.lang_pred for r in odd} == {"und"}
    assert langid.apply(make([])).count() == 0


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 500 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), again and len(again) or 0


def test_rules_equal_plain_python(make, awkward, spark):
    rng = random.Random(4)
    texts = [t for t in awkward if len(t or "") < 1000]
    texts += ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = {r.doc_id: r for r in quality_rules.score(make(texts), [0.0] * 11).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality_rules.score(make([]), [0.0] * 11).count() == 0
    assert quality_rules.score(make(awkward), [0.0] * 11).count() == len(awkward)


def test_log_ratio_keeps_the_trusted_kind(make, spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS["en"]) for _ in range(80)) for _ in range(60)]
    texts += [" ".join(rng.choice(WORDS["en"]) + "###" for _ in range(80)) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(60, 70)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make(texts)
    few = quality_rules.log_ratios(docs, quality_rules.trusted_ids(labels), buckets=211)  # for a few thousand words
    assert all(r.kept == (r.doc_id < 60) for r in quality_rules.score(docs, few).collect())
    assert quality_rules.apply(docs, labels).count() == 80
    ratios = quality_rules.log_ratios(make(texts), quality_rules.trusted_ids(labels.limit(0)))
    assert set(ratios) == {0.0}


@pytest.fixture
def ran(monkeypatch, spark):
    """The final plans of all collects."""
    plans, kind = [], type(spark.range(1))
    collect = kind.collect

    def noted(self):
        rows = collect(self)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(kind, "collect", noted)
    return plans


@pytest.mark.parametrize("most", [0, 32 * 1024 * 1024])
def test_trusted_ids_are_never_broadcast(make, spark, monkeypatch, ran, most):
    monkeypatch.setattr("lexfit.llm.common.BROADCAST_BYTES", most)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    ratios = quality_rules.log_ratios(make(["a b c"] * 60), quality_rules.trusted_ids(labels), buckets=11)
    assert len(ratios) == 11 and ran
    assert not [line for plan in ran for line in plan.splitlines() if "BroadcastHashJoin [doc_id" in line]


def test_salted_copies_are_never_broadcast(make, spark, monkeypatch):
    monkeypatch.setattr("lexfit.llm.common.BROADCAST_BYTES", 0)
    right = stage(spark.range(40).select(F.col("id").alias("doc_id"), F.lit(True).alias("found")), "few")
    joined = lookup(make(["a"] * 60).select("doc_id", "text"), right, ["doc_id"], "left")
    assert sorted((r.doc_id, r.found) for r in joined.collect()) == [(i, True if i < 40 else None) for i in range(60)]
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [3, 25])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_marked_equals_plain_membership(make, spark, monkeypatch, bits, kind):
    monkeypatch.setattr(quality_rules, "SLOT_BITS", bits)  # with 3, ids that are not trusted share slots
    trusted = {i for i in range(0, 900, 7)} | {-5, 2**40}
    ids = [None, None, -5, 2**40, -(2**40), *[14] * 50, *[15] * 50, *range(1000)]
    known = stage(spark.createDataFrame([(i,) for i in sorted(trusted) if kind != "int" or abs(i) < 2**31], "doc_id long").select(F.col("doc_id").cast(kind)), "known")
    rows = quality_rules.marked(make([f"{i} {k}" for k, i in enumerate(ids)], ids=ids), known).collect()
    held = trusted if kind != "int" else trusted - {2**40}
    assert sorted((r.text, r.t) for r in rows) == sorted((f"{i} {k}", i in held) for k, i in enumerate(ids))
    null = quality_rules.marked(make([None, ""], ids=[0, 1]), known).collect()
    assert {(r.text, r.t) for r in null} == {(None, True), ("", False)}
    none = quality_rules.marked(make(["x"]), known.limit(0)).collect()
    assert [(r.text, r.t) for r in none] == [("x", False)]


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    for _ in range(5000):
        text = "".join(rng.choice("ab1.@+- ()2%_é") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain_base(text)
    card = "4111 1111 1111 1111"
    text = f"x {card}, +1 (555) 555-1234; a.b@c.de 10.0.0.255 10.0.0.256; {card[:-1]}2"
    assert [k for _, k, _ in pii.base_spans(text)] == [2, 3, 0, 1]


def test_personal_data_added_and_redacted(make, awkward):
    rng = random.Random(9)
    texts = [f"{prose(rng, n=8)} {rng.choice(['joe', 'ann.b', 'k'])}{i if i % 3 else ''}@{rng.choice(['mail', 'post', 'web'])}.example.com {prose(rng, n=3)} +1 ({i:03d}) 555-{1000 + i}; 10.{i}.3.{i}" for i in range(100, 180)]
    texts += ["write to ann.b7[at]example[dot]com or not", *(x for x in awkward if len(x or "") < 1000), "order 1234567890123"]
    docs = make(texts)
    model = pii.train(docs)
    rows = {r.doc_id: r for r in pii.apply(docs, model).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        assert rows[i].base == pii.joined(base)
        assert set(rows[i].base.split(",")) <= set(rows[i].spans.split(",")) or not base
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
    assert rows[80].spans.startswith("email:9:") and "[EMAIL]" in rows[80].redacted
    assert rows[len(texts) - 1].spans == "" and rows[81].redacted is None
    new = {r.doc_id: r for r in pii.redact_column(docs, model).collect()}
    assert all(r.text == rows[i].redacted and r.n_chars == (None if r.text is None else len(r.text)) for i, r in new.items())
    assert pii.train(make(["no data", None])) is None and pii.apply(make([]), None).count() == 0


def test_personal_data_learns_beside_hot_forms(make):
    """A form with hundreds of thousands of equal candidates neither crowds out the others nor gets lost."""
    rng = random.Random(10)
    texts = [" ".join(["bob@web.example.com x"] * 400) for _ in range(160)]
    texts += [f"{prose(rng, n=8)} tel +1 ({i:03d}) 555-{1000 + i}; {prose(rng, n=3)} 10.{i}.3.{i} and 300.1.2.{i}" for i in range(100, 180)]
    model = pii.train(make(texts))
    text = "mail joe (at) web.example.com or tel (212) 555-1234"
    assert [k for _, k, _ in pii.find(text, model)[1]] == [0, 3]
    assert pii.find("see 300.1.2.7 now", model)[1] == []


RESPELT = [
    ("mail joe (at) web.example.com now", "joe (at) web.example.com"), ("mail name at host dot com now", "name at host dot com"),
    ("call 030 1234567 soon", "030 1234567"), ("tel 0049 30 1234567", "0049 30 1234567"), ("fax 040/1234567 x", "040/1234567"),
    ("tel 555 123 4567", "555 123 4567"), ("paid 4111/1111/1111/1111 x", "4111/1111/1111/1111"),
    ("order 12 4111 1111 1111 1111", "4111 1111 1111 1111"), ("host 10[.]0[.]0[.]1 up", "10[.]0[.]0[.]1"), ("10 dot 0 dot 0 dot 1", "10 dot 0 dot 0 dot 1"),
    ("call +1 (826) 555-4081 190.137.223.204", "+1 (826) 555-4081"),
]
HARMLESS = [
    "we looked at example.com today", "he was at home.Then", "on 2024-03-01 we", "on 01.02.2024 we", "12.345.678 items", "paid 4111/1111/1111/1112 x",
    "1 2 3 4 5 6 7 8 9 10 11 12", "id 1234567890", "see 300.1.2.7 now", "10[.]0[.]0[.]999", "at 10.30 dot", "\u0661\u0662\u0663 at x",
]


def test_personal_data_in_forms_the_base_does_not_know(make):
    """Learnt from base spans alone: respelt addresses, numbers of other groupings, cards and quads with other signs."""
    rng = random.Random(11)
    card = lambda d: next(d + str(x) for x in range(10) if pii.luhn(d + str(x)))
    texts = [f"{prose(rng, n=9)} user{i}@mail{i % 7}.example.com {prose(rng, n=4)} +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} {rng.choice(['und', 'le'])}" for i in range(150)]
    texts += [f"{prose(rng, n=5)} {card(str(rng.randint(10**14, 10**15 - 1)))} {prose(rng, n=4)} {'.'.join(str(rng.randint(1, 255)) for _ in range(4))} x" for _ in range(150)]
    model = pii.train(make(texts))
    for text, span in RESPELT:
        base, spans = pii.find(text, model)
        assert [text[a:b] for a, _, b in spans if (a, _, b) not in base] == [span], text
    for text in HARMLESS:
        assert pii.find(text, model)[1] == [], text
    for text in texts:  # nothing is added to texts whose personal data the base finds
        base, spans = pii.find(text, model)
        assert base == spans


def test_stretches_taken_equal_plain_overlaps():
    rng = random.Random(12)
    for _ in range(500):
        spans = [(a := rng.randrange(60), 0, a + rng.randint(1, 9)) for _ in range(rng.randrange(8))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = rng.randrange(70)
            b = a + rng.randint(1, 9)
            assert taken.meets(a, b) == any(a < e and s < b for s, _, e in spans)
            if not taken.meets(a, b):
                taken.add(a, b)
                spans.append((a, 0, b))


def test_long_texts_are_searched_whole_for_personal_data():
    """A text of many spans: all found, in time that does not grow with the square of their number."""
    model = pii.Boosted([np.array([0.5])] * len(pii.features("1", 0, 1, 1)), 9.0, thresholds=[0.5] * 4)
    text = "a.b@c.de, 10.0.0.1; 030 1234567 " * 20_000
    base, spans = pii.find(text, model)
    assert (len(base), len(spans)) == (40_000, 60_000)


def test_log_ratio_counts_all_trusted_documents(make, spark, monkeypatch):
    """More trusted documents than any sample held; broadcast or dealt out, each is counted."""
    n = 12_000
    docs = make(["alpha"] * n + ["beta"] * n + ["gamma"])
    labels = spark.range(2 * n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    monkeypatch.setattr(quality_rules, "SMOOTHING", 1e-9)
    for most in (1 << 25, 0):
        monkeypatch.setattr("lexfit.llm.common.BROADCAST_BYTES", most)
        ratios = quality_rules.log_ratios(docs, quality_rules.trusted_ids(labels), 10_007)
        grams = docs.where("text <> 'gamma'").select("text", quality_rules.gram_buckets(quality_rules.word_hashes(docs["text"]), 10_007)).distinct().collect()
        assert len(grams) == 2 and all(abs(ratios[b] - np.log((2 * n + 1) / (2 * n))) < 1e-8 for _, (b,) in grams)


def test_log_ratio_of_few_trusted_documents_with_the_parameters_in_use(make, spark):
    """A few thousand trusted words reject no text of their kind, and enough of them reject the other kind."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS["en"]) for _ in range(80)) for _ in range(60)]
    texts += [" ".join(rng.choice(WORDS["en"]) + "###" for _ in range(80)) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(60, 70)], "doc_id long, quality int, toxic int")
    assert all(r.kept == (r.doc_id < 60) for r in quality_rules.apply(make(texts), labels).collect())
    one = quality_rules.apply(make(texts), labels.limit(1)).collect()
    assert all(r.kept for r in one if r.doc_id < 60)


def test_rare_languages_and_repeated_ids_are_learnt_from_within_bounds(make):
    texts = [f"the cat and the dog {i}" for i in range(300)] + [f"der hund und die katze {i}" for i in range(6)] + ["the cat again"] * 50
    langs = ["en"] * 300 + ["de"] * 6 + ["en"] * 50
    docs = make(texts, langs=langs, ids=[*range(306), *[0] * 50])
    rows = langid.training_rows(docs, 20, 10)
    assert {r[2] for r in rows} == {"en", "de"} and len(rows) <= 20 + 10 * 2
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(306)] + [(0, 1)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels)
    assert model is not None


def test_ip_alone_is_a_training_candidate():
    assert [y for _, y in pii.trace("host 10.0.0.1 up")][:1] == [1.0] and list(pii.trace("no number")) == []
