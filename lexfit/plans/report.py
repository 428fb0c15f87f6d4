"""The whole path from ad records to scored, selected and rendered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import records as R
from lexfit.functions.stemming import cistem, snowball_german
from lexfit.functions.text import extract_emails, remove_stopwords, tokens_to_text
from lexfit.operators import cleaning, pages, ranking, scoring, sections, selection
from lexfit.operators.language import detect_language
from lexfit.operators.terms import lemmatize, prepare_terms
from lexfit.schemas import SECTIONS, TOKEN_STEPS
from lexfit.session import stage
from lexfit.sources.store import conform
from lexfit.sources.tables import term_table


def prepare_records(records: DataFrame, extra_keywords: dict | None = None) -> DataFrame:
    """Replacements, title cleaning and filter, job id, mail addresses, the four sections. Narrow."""
    parts = F.col("parts")
    records = cleaning.replace_columns(records).withColumn("parts", R.replace_parts(parts))
    return cleaning.title_blocklist(
        records.withColumn("title", R.title_clean(F.col("title")))
    ).select(
        R.job_id(F.col("url")).alias("job_id"),
        "*",
        F.coalesce(extract_emails(F.get(parts, F.lit(8))), F.lit("")).alias("email"),
        sections.section_tasks(parts, extra_keywords).alias("tasks"),
        sections.section_profile(parts, extra_keywords).alias("profile"),
        sections.section_benefits(parts, extra_keywords).alias("benefits"),
        sections.section_contact(parts, extra_keywords).alias("contact"),
    )


def token_steps(
    prepared: DataFrame,
    key: str = "url",
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    stem: bool = True,
) -> DataFrame:
    """``(key, section, clean, lemma, stem1, stem2, no_stop)``: each scored section as a
    blank-joined text after each step. Narrow unless a lemma table is given; columns that
    are not used further cost nothing.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("clean")) for s in SECTIONS])
    long = prepared.select(key, F.inline(cells))
    long = long.withColumn("clean", cleaning.token_text(F.col("clean")))
    if lemmas is None:
        long = long.withColumn("lemma", F.col("clean"))
    else:
        ids = long.select(F.struct(key, "section").alias("_id"), F.col("clean").alias("lemma"))
        found = lemmatize(ids, "_id", "lemma", lemmas).select("_id.*", "lemma")
        long = long.join(found, [key, "section"])
    long = long.withColumn("stem1", snowball_german(F.col("lemma")) if stem else F.col("lemma"))
    long = long.withColumn("stem2", cistem(F.col("stem1")) if stem else F.col("stem1"))
    kept = F.col("stem2")
    if stop_words:
        kept = tokens_to_text(remove_stopwords(F.split("stem2", " "), stop_words))
    return long.withColumn("no_stop", kept).select(key, "section", *TOKEN_STEPS)


def section_features(texts: DataFrame, profiles: DataFrame, key: str = "url") -> DataFrame:
    """A few numbers per text and section. Kept as a table and appended to with each
    batch, they are all that rescoring needs when the corpus grows."""
    return scoring.score_features(texts, [key], profiles)


def scores(features: DataFrame, profiles: DataFrame, key: str = "url") -> DataFrame:
    """``(key, section, cosine, jaccard, matched)`` from a feature table."""
    scored = scoring.matched(scoring.jaccard(scoring.cosine(features, profiles)))
    # Benefits have no list of matches.
    matched = F.when(F.col("section") != "benefits", F.col("matched"))
    return scored.select(key, "section", "cosine", "jaccard", matched.alias("matched"))


MEASURES = ("cosine", "jaccard")


def rank_long(scored: DataFrame, key: str = "url") -> DataFrame:
    """One row per text, section and measure, with its rank.

    Both measures go through one ranking, as groups of one long table.
    """
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in MEASURES])
    rest = [c for c in scored.columns if c not in MEASURES]
    long = scored.select(*rest, F.inline(measures))
    return ranking.rank_average(long, ["section", "measure"], "score", [key])


def rank_sections(scored: DataFrame, key: str = "url") -> DataFrame:
    """Both ranks of each section score and their difference."""
    ranked = rank_long(scored.select(key, "section", *MEASURES), key)
    wide = ranked.groupBy(key, "section").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("rank"))).alias(f"{m}_rank") for m in MEASURES]
    )
    return wide.withColumn("rank_diff", ranking.rank_difference("cosine_rank", "jaccard_rank"))


def widen(scored: DataFrame, columns: tuple[str, ...], key: str = "url") -> DataFrame:
    """One row per text with ``<section>_<column>`` columns."""
    return scored.groupBy(key).agg(
        *[
            F.max(F.when(F.col("section") == s, F.col(c))).alias(f"{s}_{c}")
            for s in SECTIONS
            for c in columns
        ]
    )


def with_totals(wide: DataFrame) -> DataFrame:
    return wide.withColumns(
        {f"total_{m}": scoring.total_score(suffix=f"_{m}") for m in ("cosine", "jaccard")}
    )


def fit_report(
    records: DataFrame,
    terms: DataFrame,
    key: str = "url",
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    extra_keywords: dict | None = None,
) -> DataFrame:
    """Records to one row per ad with scores, ranks, matches and totals."""
    prepared = prepare_records(records, extra_keywords)
    texts = token_steps(prepared, key, stop_words, lemmas).select(key, "section", F.col("no_stop").alias("text"))
    return report_from_texts(texts, prepare_terms(terms, lemmas), key)


def report_from_texts(texts: DataFrame, query: DataFrame, key: str = "url") -> DataFrame:
    profiles = stage(scoring.term_profiles(query), "profiles")
    features = stage(section_features(texts, profiles, key), "features")
    scored = stage(scores(features, profiles, key), "scores")
    return report_rows(rank_long(scored, key), key)


def full_store(
    records: DataFrame,
    terms: DataFrame,
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    extra_keywords: dict | None = None,
    language_model: DataFrame | None = None,
) -> DataFrame:
    """Records to store rows with every column a run fills: found values, sections, the
    tokens after each step, scores, ranks, matches and totals. ``url`` is unique.

    Pages and texts are gone through once; prepared rows and tokens are staged.
    """
    prepared = stage(prepare_records(records, extra_keywords), "prepared")
    steps = stage(token_steps(prepared, "url", stop_words, lemmas), "tokens")
    texts = steps.select("url", "section", F.col("no_stop").alias("text"))
    report = report_from_texts(texts, prepare_terms(terms, lemmas))

    columns = []
    for s in SECTIONS:
        for step in TOKEN_STEPS:
            text = F.max(F.when(F.col("section") == s, F.col(step)))
            columns.append(F.array_remove(F.split(text, " "), "").alias(f"{s}_{step}"))
        columns.append(F.max(F.when(F.col("section") == s, F.col("no_stop"))).alias(f"{s}_joined"))
    wide = steps.groupBy("url").agg(*columns)

    rows = prepared.join(report, "url").join(wide, "url")
    if language_model is not None:
        spoken = prepared.select("url", cleaning.language_text(F.col("parts")).alias("text"))
        found = detect_language(spoken, "url", language_model)
        rows = rows.drop("lang").join(found.withColumnRenamed("detected", "lang"), "url")
    return conform(rows)


def page_letters(
    store: DataFrame,
    landed: DataFrame,
    company_pages: DataFrame,
    terms: DataFrame,
    texts: list[Column],
    thresholds: dict[str, float] = fx.THRESHOLDS,
    stop_words: list[str] | None = None,
    lemmas: DataFrame | None = None,
    extra_keywords: dict | None = None,
    **address,
) -> DataFrame:
    """Stored ad records to the letters of those worth one, with the file name, ``texts``
    (columns over title, company and address) and the scores that chose them.

    ``store`` and ``landed(page_id, url, html)`` are unique on url. Addresses, which may
    stand on company pages only, are resolved by ``pages.address_resolve(**address)`` once
    the rows are chosen: of the landed pages, those of chosen rows alone are parsed for them.
    """
    prepared = stage(prepare_records(store, extra_keywords), "prepared")
    steps = token_steps(prepared, "url", stop_words, lemmas).select("url", "section", F.col("no_stop").alias("text"))
    report = report_from_texts(steps, prepare_terms(terms, lemmas))
    measures = [f"{s}_jaccard" for s in (*SECTIONS, "total")]
    open_rows = prepared.select("url", "title", "company", "email", F.lit(None).cast("string").alias("letter_done"), F.lit(None).cast("string").alias("file_name"))
    scored = open_rows.join(report.select("url", *measures), "url")
    chosen = stage(selection.mark_done(scored.where(selection.eligible(thresholds)), F.lit(True)), "chosen")
    ads = landed.join(chosen.select("url"), "url", "left_semi")
    found = pages.address_resolve(ads, company_pages, **address).join(ads.select("page_id", "url"), "page_id")
    return chosen.join(found.select("url", "address"), "url", "left").select("url", "company", "title", "email", "file_name", *texts, *measures)


def report_rows(ranked: DataFrame, key: str) -> DataFrame:
    """The ranked long table to one row per text: a single shuffle, numbers and matches only."""

    def pick(section: str, column: str, measure: str) -> Column:
        here = (F.col("section") == section) & (F.col("measure") == measure)
        return F.max(F.when(here, F.col(column)))

    columns = []
    for s in SECTIONS:
        for m in MEASURES:
            columns.append(pick(s, "score", m).alias(f"{s}_{m}"))
            columns.append(pick(s, "rank", m).alias(f"{s}_{m}_rank"))
        if s != "benefits":
            columns.append(pick(s, "matched", MEASURES[0]).alias(f"{s}_matched"))
    wide = ranked.groupBy(key).agg(*columns)
    diffs = {
        f"{s}_rank_diff": ranking.rank_difference(f"{s}_cosine_rank", f"{s}_jaccard_rank") for s in SECTIONS
    }
    return with_totals(wide.withColumns(diffs))


def default_terms(spark) -> DataFrame:
    """The default term lists as a table."""
    return term_table(spark, fx.PROFILE_TERMS)
