"""Every operator as a query on the driver tables, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import html as H
from lexfit.functions import records as R
from lexfit.functions import text as T
from lexfit.functions.stemming import cistem, snowball_german
from lexfit.operators import blocklist, cleaning, language, pages, ranking, scoring, sections, selection, terms
from lexfit.plans import report
from lexfit.session import scratch_path, stage
from lexfit.sources import status
from lexfit.sources import store as S
from lexfit.sources.tables import page_scan, table, term_table
from lexfit.streaming.incremental import follow_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# --- parameters that fit the driver tables ------------------------------------
BASE = "https://www.example.com"
TERMS = {
    "tasks": ["the", "of", "für", "de la", "zzz", "the", "a", "und", "Thin"],
    "profile": ["los", "para", "que", "Ering", "it-affinität", "of", "mit"],
    "benefits": ["est", "dans", "die", "sch", "thing", "und"],
}
STOP_WORDS = ["the", "and", "der", "und", "los", "que", "les", "est", "a", "of", "in", "to"]
BLOCKLIST = ["ring", "STANDARD", "Chemie"]
EXTRA_KEYWORDS = {
    ("tasks", 1): ["the", "der"], ("tasks", 2): ["los.*de"],
    ("profile", 1): ["of", "les"],
    ("benefits", 1): ["and", "et"], ("benefits", 2): [".*que.*"], ("benefits", 3): ["is"],
    ("contact", 1): ["to", "la"],
}
THRESHOLDS = {"tasks": 0.004, "profile": 0.002, "benefits": 0.0, "total": 0.03}
PAGE_THRESHOLDS = {"tasks": 0.02, "profile": 0.01, "benefits": 0.0, "total": 0.015}
TITLE_MARKERS = ("<title>", "</title>")
COMPANY_MARKERS = ("<footer>&copy; ", " &middot;")
ADDRESS_PATTERN = "<p>(.+?)</p>"
OWN_ADDRESS_PATTERN = "<article><h1>[^<,]*,([^<]*)</h1>"
CARD_PATTERN = "<li><a href=['\"]?([^'\" >]+)"
FACTS_PATTERNS = ['(?s)<div class="ad">(.{200,}?)</div>', "(?s)<footer>(.+?)</footer>"]
DROP_PREFIXES = ["Fakten", "http", "th", "Nicht"]
SIZE_WORDS = ["of", "sch"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared views --------------------------------------------------------------
def _exploded(df: DataFrame, key: str, items: Column, name: str) -> DataFrame:
    out = df.select(key, F.posexplode_outer(items).alias("pos", name)).where(f"{name} is not null")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return page_scan(spark, d)


def _terms(spark: SparkSession) -> DataFrame:
    return term_table(spark, TERMS)


def _query_terms(spark: SparkSession) -> DataFrame:
    return terms.prepare_terms(_terms(spark), stem=False)


def _doc_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.token_text(F.col("text")).alias("text"))


def _doc_parts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.split("text", "\n").alias("parts"))


def _doc_records(spark: SparkSession, d: str) -> DataFrame:
    url = F.format_string("https://%s.example.com/jobs--%07d-inline.html", "source", "doc_id")
    parts = F.split("text", "\n")
    return _docs(spark, d).select(
        url.alias("url"),
        F.get(parts, F.lit(0)).alias("title"),
        F.col("source").alias("company"),
        F.lit(None).cast("array<string>").alias("address"),
        parts.alias("parts"),
        F.lit(0).cast("bigint").alias("batch_no"),
        F.col("doc_id").alias("pos"),
    )


def _features(spark: SparkSession, d: str, *names: str, vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each document's text under each section name, gone through once."""
    profiles = scoring.term_profiles(_query_terms(spark))
    texts = _doc_texts(spark, d)
    return scoring.score_features(texts, ["doc_id"], profiles, sections=list(names or TERMS), vectors=vectors), profiles


def _scores(spark: SparkSession, d: str) -> DataFrame:
    features, profiles = _features(spark, d)
    features = stage(features, "features")
    scored = scoring.jaccard(scoring.cosine(features, profiles))
    return stage(scored.select("doc_id", "section", "cosine", "jaccard"), "scores")


def _jaccard_wide(spark: SparkSession, d: str) -> DataFrame:
    features, _ = _features(spark, d, vectors=False)
    return report.widen(scoring.jaccard(features), ("jaccard",), "doc_id").withColumn(
        "total_jaccard", scoring.total_score(suffix="_jaccard")
    )


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Scored documents with a status: 'done' comes from the labels table."""
    done = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(fx.DONE).alias("letter_done"))
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.col("source").alias("company"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.nullif(T.extract_emails(F.col("text")), F.lit("")).alias("email"),
    )
    scored = _jaccard_wide(spark, d).join(docs, "doc_id").join(done, "doc_id", "left")
    return scored.withColumns(
        {"file_name": F.lit(None).cast("string"), "sent": F.lit(None).cast("string")}
    )


def _company_pages(landed: DataFrame) -> DataFrame:
    """The company page behind a card link: of the pages that show the link first, the earliest."""
    companies = landed.select("page_id", H.first_group(F.col("html"), CARD_PATTERN).alias("link"), "html")
    return cleaning.dedupe_first(companies.where("link is not null"), "link", ("page_id",)).select("link", "html")


def _parts(titles: DataFrame) -> DataFrame:
    return titles.select("p_partkey", F.col("p_brand").alias("company"), F.concat_ws(" ", "p_name", "p_type").alias("title"))


def _marked_title() -> Column:
    """Part names with one of the gender markers put in, by part size."""
    markers = F.array(*[F.lit(m) for m in fx.GENDER_MARKERS], F.lit(""))
    marker = F.get(markers, F.col("p_size") % (len(fx.GENDER_MARKERS) + 1))
    return F.concat_ws(" ", "p_name", marker, "p_type", marker)


# --- sources and sinks -----------------------------------------------------------
@query
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    return spark.read.schema(schema).parquet(f"{d}/documents.parquet")


@query
def store_write(spark: SparkSession, d: str) -> DataFrame:
    records = _doc_records(spark, d)
    path = scratch_path(spark, "store-csv")
    S.write_csv_store(records, path)
    back = S.read_csv_store(spark, path, records.schema)
    return back.select("url", "title", "company", F.array_join("parts", "\n").alias("body"), "batch_no", "pos")


@query
def store_init(spark: SparkSession, d: str) -> DataFrame:
    store = S.union_batches(S.store_init(spark), S.conform(_doc_records(spark, d)))
    missing = sum((F.col(c).isNull().cast("bigint") for c in store.columns), F.lit(0).cast("bigint"))
    return store.select(
        "url", "company", F.size("parts").cast("bigint").alias("n_parts"), "pos",
        missing.alias("n_missing"),
    )


@query
def store_append(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("url"), "text", "lang", F.lit(0).cast("bigint").alias("batch_no")
    )
    turns = table(spark, d, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("url"), "text", "role"
    )
    return S.store_append(docs, turns)


@query
def union_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.union_batches(
        table(spark, d, "documents").select("doc_id", "text", "lang"),
        table(spark, d, "conversations").select("conv_id", "turn", "role", "text"),
        table(spark, d, "benchmark").select("item_id", "text"),
    )


@query
def page_scan_all(spark: SparkSession, d: str) -> DataFrame:
    return page_scan(spark, d)


def _archive(spark: SparkSession, landed: DataFrame) -> DataFrame:
    records = pages.page_records(
        landed, tags=["h1"], company_markers=COMPANY_MARKERS, title_markers=TITLE_MARKERS,
        address_pattern=ADDRESS_PATTERN,
    )
    texts = records.select("url", cleaning.token_text(F.array_join("parts", " ")).alias("text"))
    profiles = scoring.term_profiles(_query_terms(spark))
    scored = scoring.jaccard(scoring.score_features(texts, ["url"], profiles, sections=["tasks"], vectors=False))
    selected = stage(records.select("url", "company", "title").join(scored.where(F.col("jaccard") > 0.02), "url", "left_semi"), "selected")
    return selection.page_archive(selected, landed)


@query
def page_archive(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, _pages(spark, d))


@query
def page_archive_stored(spark: SparkSession, d: str) -> DataFrame:
    """The archive as it is read back after an attempt that was not committed, and after one too many."""
    path = scratch_path(spark, "archive")
    archive = stage(_archive(spark, _pages(spark, d)), "archive")
    archive.write.parquet(f"{path}/attempts/number=0-lost")
    for _ in range(2):
        selection.write_page_archive(archive, path, 8)
    return selection.read_page_archive(spark, path)


@query
def store_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A store fed by four batches whose keys overlap, one of them replayed: the first row of each key stays."""
    def rows(df: DataFrame, pos: Column) -> DataFrame:
        return df.select(F.concat(F.lit("text-"), F.md5(F.col("text").cast("binary"))).alias("url"), F.col("text").alias("body"), pos.alias("pos"))

    docs = rows(_docs(spark, d), F.col("doc_id"))
    turns = rows(table(spark, d, "conversations"), F.col("conv_id") * 1000 + F.col("turn"))
    items = rows(table(spark, d, "benchmark"), F.col("item_id"))
    path = scratch_path(spark, "store")
    for number, batch in ((0, turns), (1, docs), (2, S.union_batches(docs, turns)), (1, docs), (3, items)):
        S.append_batch(spark, path, batch, number)
    return S.read_keyed_store(spark, path, docs.schema).select("url", F.length("body").cast("bigint").alias("n_chars"), "pos", "batch_no")


@query
def store_stream(spark: SparkSession, d: str) -> DataFrame:
    store = scratch_path(spark, "store")

    def to_records(batch: DataFrame) -> DataFrame:
        return pages.page_records(
            batch, tags=["h1"], company_markers=COMPANY_MARKERS, title_markers=TITLE_MARKERS,
            address_pattern=ADDRESS_PATTERN,
        )

    run = follow_pages(spark, f"{d}/pages*.parquet", store, scratch_path(spark, "offsets"), to_records)
    run.awaitTermination()
    return spark.read.parquet(store).select("url", "title", "company", F.array_join("parts", "\n").alias("body"))


# --- search plan and page extraction ----------------------------------------------
@query
def search_plan(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("term"), "p_brand", "p_size"
    )
    plan = pages.search_plan(wanted, 3, F.col("p_brand"), F.col("p_size").cast("string"), BASE)
    return plan.select("p_partkey", F.col("page").cast("bigint").alias("page"), "request_url")


@query
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    links = pages.extract_links(_pages(spark, d), BASE)
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query
def links_per_page(spark: SparkSession, d: str) -> DataFrame:
    counts = pages.links_per_page(_pages(spark, d), BASE)
    return counts.select("page_id", F.col("n_links").cast("bigint").alias("n_links"))


@query
def top_n_per_page(spark: SparkSession, d: str) -> DataFrame:
    links = pages.top_n_per_page(_pages(spark, d), BASE, 3)
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query
def header_fields(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return _pages(spark, d).select(
        "page_id",
        H.between(html, COMPANY_MARKERS).alias("company"),
        H.between(html, TITLE_MARKERS).alias("title"),
    )


@query
def address_parse(spark: SparkSession, d: str) -> DataFrame:
    items = H.address_items(H.first_group(F.col("html"), ADDRESS_PATTERN))
    return _pages(spark, d).select("page_id", F.array_join(items, "|").alias("address"))


@query
def address_clean(spark: SparkSession, d: str) -> DataFrame:
    items = H.address_from_facts(F.col("html"), DROP_PREFIXES, SIZE_WORDS)
    return _pages(spark, d).select("page_id", F.array_join(items, "|").alias("address"))


@query
def address_resolve(spark: SparkSession, d: str) -> DataFrame:
    landed = _pages(spark, d)
    out = pages.address_resolve(
        landed, _company_pages(landed), OWN_ADDRESS_PATTERN, CARD_PATTERN, "<nav>",
        FACTS_PATTERNS, DROP_PREFIXES, SIZE_WORDS,
    )
    return out.select("page_id", F.array_join("address", "|").alias("address"))


@query
def heading_split(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_pages(spark, d), "page_id", H.heading_split(F.col("html"), ["h1"]), "part")


@query
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_pages(spark, d), "page_id", H.page_parts(F.col("html"), ["h1"]), "part")


@query
def drop_intro(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    parts = H.drop_intro(H.page_parts(html, ["h1"]), html, "<p>")
    return _pages(spark, d).select("page_id", F.array_join(parts, "|").alias("parts"))


def _joined_rest(wide: DataFrame) -> DataFrame:
    return wide.withColumn("part_rest", F.array_join("part_rest", "\x1f"))


@query
def parts_to_columns(spark: SparkSession, d: str) -> DataFrame:
    parts = _pages(spark, d).select("page_id", H.page_parts(F.col("html"), ["p"]).alias("parts"))
    return _joined_rest(parts.select("page_id", *H.part_columns(F.col("parts"))))


# --- row cleaning -------------------------------------------------------------------
@query
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("text", "doc_id", F.lit(1).alias("batch_no"))
    turns = table(spark, d, "conversations").select(
        "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(0).alias("batch_no")
    )
    first = cleaning.dedupe_first(S.union_batches(turns, docs), "text", ("batch_no", "doc_id"))
    return first.select("text", "doc_id", F.col("batch_no").cast("bigint").alias("batch_no"))


@query
def job_id(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("url", R.job_id(F.col("url")).alias("job_id"))


@query
def replace_multi(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    wide = _pages(spark, d).select(
        "page_id",
        H.between(html, COMPANY_MARKERS).alias("company"),
        H.between(html, TITLE_MARKERS).alias("title"),
        *H.part_columns(H.heading_split(html, ["p"])),
    )
    return _joined_rest(cleaning.replace_columns(wide))


@query
def title_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.title_clean(_marked_title()).alias("title"))


@query
def title_blocklist(spark: SparkSession, d: str) -> DataFrame:
    titled = _parts(table(spark, d, "part"))
    return cleaning.title_blocklist(titled, BLOCKLIST).select("p_partkey", "title")


@query
def title_blocklist_table(spark: SparkSession, d: str) -> DataFrame:
    """First lines of documents that hold no long word of the benchmark."""
    words = terms.vocabulary(table(spark, d, "benchmark").select(cleaning.token_text(F.col("text")).alias("text")), "text")
    listed = words.where("length(token) > 8").select(F.col("token").alias("term"))
    titled = _docs(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return blocklist.drop_blocked(titled, listed)


@query
def concat_text(spark: SparkSession, d: str) -> DataFrame:
    return _doc_parts(spark, d).select("doc_id", cleaning.language_text(F.col("parts")).alias("text"))


@query
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return language.detect_language(docs, "doc_id", language.language_model(docs))


@query
def language_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """The languages of conversation turns by a model fitted on documents."""
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return language.detect_language(turns, "key", language.language_model(_docs(spark, d)))


@query
def extract_emails(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.extract_emails(F.col("text")).alias("emails"))


# --- section lookup -------------------------------------------------------------------
def _section(name: str) -> Query:
    lookup = getattr(sections, f"section_{name}")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _doc_parts(spark, d).select("doc_id", lookup(F.col("parts"), EXTRA_KEYWORDS).alias("section"))

    return run


for _name in ("tasks", "profile", "benefits", "contact"):
    QUERIES[f"section_{_name}"] = _section(_name)


def _section_of_record(name: str) -> Query:
    lookup = getattr(sections, f"section_{name}")

    def run(spark: SparkSession, d: str) -> DataFrame:
        records = _doc_records(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("pos"), "lang"), "pos")
        fields = [R.job_id(F.col("url")), F.col("url"), F.col("title"), F.col("company"), F.col("lang")]
        cells = sections.scan_cells(F.col("parts"), *fields)
        return records.select(F.col("pos").alias("doc_id"), lookup(cells, EXTRA_KEYWORDS, len(fields)).alias("section"))

    return run


for _name in ("tasks", "profile", "benefits", "contact"):
    QUERIES[f"section_{_name}_record"] = _section_of_record(_name)


# --- text normalisation -----------------------------------------------------------------
@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokenize(T.clean_text(F.col("text")))
    return _exploded(_docs(spark, d), "doc_id", tokens, "token")


@query
def lemmatize(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(cleaning.token_text(F.col("text")).alias("text"))
    words = terms.vocabulary(items, "text").where("length(token) > 4")
    lemmas = words.select("token", F.substring("token", 1, 4).alias("lemma"))
    return terms.lemmatize(_doc_texts(spark, d), "doc_id", "text", lemmas)


@query
def stem_snowball(spark: SparkSession, d: str) -> DataFrame:
    return _doc_texts(spark, d).select("doc_id", snowball_german(F.col("text")).alias("text"))


@query
def stem_cistem(spark: SparkSession, d: str) -> DataFrame:
    return _doc_texts(spark, d).select("doc_id", cistem(snowball_german(F.col("text"))).alias("text"))


@query
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = terms.vocabulary(_doc_texts(spark, d), "text")
    return terms.stem_dictionary(words)


@query
def remove_stopwords(spark: SparkSession, d: str) -> DataFrame:
    kept = T.remove_stopwords(F.split("text", " "), STOP_WORDS)
    return _doc_texts(spark, d).select("doc_id", T.tokens_to_text(kept).alias("text"))


@query
def prepare_terms(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").select(
        F.col("p_brand").alias("section"), F.col("p_partkey").alias("pos"),
        F.concat_ws(" ", "p_name", "p_type").alias("term"),
    )
    prepared = terms.prepare_terms(wanted)
    return prepared.select("section", "pos", "term")


@query
def tokens_to_text(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.tokenize(T.clean_text(F.col("text")))
    return _docs(spark, d).select("doc_id", T.tokens_to_text(tokens).alias("text"))


# --- matching, scoring, ranking --------------------------------------------------------------
@query
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.term_counts(_doc_texts(spark, d), "doc_id")


@query
def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    known = scoring.corpus_vocabulary(_doc_texts(spark, d), _query_terms(spark), sections=list(TERMS))
    return known.select("section", "pos", "term")


def _cosine(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        features, profiles = _features(spark, d, name)
        scored = scoring.cosine(stage(features, "features"), profiles)
        return scored.select("doc_id", F.round("cosine", 6).alias("score"))

    return run


def _matched(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        features, profiles = _features(spark, d, name)
        scored = scoring.matched(scoring.cosine(stage(features, "features"), profiles))
        return scored.select("doc_id", "matched")

    return run


def _jaccard(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        features, _ = _features(spark, d, name, vectors=False)
        return scoring.jaccard(features).select("doc_id", F.round("jaccard", 6).alias("score"))

    return run


for _name in TERMS:
    QUERIES[f"cosine_{_name}"] = _cosine(_name)
    QUERIES[f"jaccard_{_name}"] = _jaccard(_name)
for _name in ("tasks", "profile"):
    QUERIES[f"matched_{_name}"] = _matched(_name)


@query
def rank_average(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d)
    ranked = ranking.rank_average(scores, ["section"], "jaccard", ["doc_id"])
    return ranked.select("doc_id", "section", "rank")


@query
def rank_batches(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after a second batch: documents first, turns of conversations later. Of the documents only the
    stored scores and their histogram are read again."""
    profiles = scoring.term_profiles(_query_terms(spark))
    turns = table(spark, d, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("url"), cleaning.token_text(F.col("text")).alias("text")
    )
    docs = _doc_texts(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("url"), "text")
    scores, histograms = [], []
    for batch in (docs, turns):
        features = scoring.score_features(batch, ["url"], profiles, sections=["tasks", "profile"], vectors=False)
        scores.append(stage(scoring.jaccard(features).select("url", "section", "jaccard"), "batch-scores"))
        histograms.append(stage(ranking.score_histogram(scores[-1], ["section"], "jaccard"), "batch-histogram"))
    merged = ranking.merge_histograms(histograms, ["section"])
    ranked = ranking.rank_average(S.union_batches(*scores), ["section"], "jaccard", ["url"], histogram=merged)
    return ranked.select("url", "section", "rank")


@query
def rank_difference(spark: SparkSession, d: str) -> DataFrame:
    return report.rank_sections(_scores(spark, d), "doc_id")


@query
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    means = ranking.rank_agreement(report.rank_sections(_scores(spark, d), "doc_id"))
    return means.select("section", F.round("mean_rank_diff", 4).alias("mean_rank_diff"))


@query
def total_score(spark: SparkSession, d: str) -> DataFrame:
    totals = report.with_totals(report.widen(_scores(spark, d), ("cosine", "jaccard"), "doc_id"))
    return totals.select(
        "doc_id", F.round("total_cosine", 6).alias("total_cosine"), F.round("total_jaccard", 6).alias("total_jaccard")
    )


# --- selection and output tables --------------------------------------------------------------
@query
def select_eligible(spark: SparkSession, d: str) -> DataFrame:
    chosen = selection.select_eligible(_letters(spark, d), thresholds=THRESHOLDS)
    return chosen.select("doc_id", F.round("total_jaccard", 6).alias("total_jaccard"))


@query
def safe_file_name(spark: SparkSession, d: str) -> DataFrame:
    name = selection.letter_file_name(F.col("p_brand"), _marked_title())
    return table(spark, d, "part").select("p_partkey", name.alias("file_name"))


@query
def address_lines(spark: SparkSession, d: str) -> DataFrame:
    items = H.address_items(H.first_group(F.col("html"), OWN_ADDRESS_PATTERN))
    return _pages(spark, d).select("page_id", R.address_lines(items).alias("lines"))


@query
def render_text(spark: SparkSession, d: str) -> DataFrame:
    titled = _parts(table(spark, d, "part")).withColumn("address", F.split("title", " "))
    texts = selection.letter_texts("Als Teamplayer.", "01.02.2025", "Hamburg", F.to_date(F.lit("2025-01-02")))
    return titled.select("p_partkey", *texts)


@query
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    features, profiles = _features(spark, d, "tasks")
    scored = scoring.matched(scoring.cosine(stage(features, "features"), profiles))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    prompt = selection.prompt_text(F.col("lang"), F.col("source"), F.col("matched"))
    return scored.join(docs, "doc_id").select("doc_id", prompt.alias("prompt"))


@query
def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _docs(spark, d).select("doc_id", T.tidy_text(F.concat(F.lit("\t"), doubled)).alias("text"))


@query
def mark_status(spark: SparkSession, d: str) -> DataFrame:
    marked = selection.mark_done(_letters(spark, d), selection.eligible(thresholds=THRESHOLDS))
    return selection.mark_sent(marked).select("doc_id", "file_name", "letter_done", "sent")


@query
def status_merge(spark: SparkSession, d: str) -> DataFrame:
    """Status of all documents after three runs of changes, one replayed, folded between: marked, sent, renamed."""
    url = F.concat(F.lit("doc-"), "doc_id").alias("url")
    path = scratch_path(spark, "status")
    labels = table(spark, d, "labels")
    marked = _docs(spark, d).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    marked = marked.select(url, selection.letter_file_name(F.col("source"), F.col("lang")).alias("file_name"), F.lit(fx.DONE).alias("letter_done"))
    mails = _docs(spark, d).where(F.contains("text", F.lit("@"))).select(url, F.lit(fx.DONE).alias("sent"))
    renamed = labels.where("toxic = 1").select(url, F.lit("withheld").alias("file_name"))
    status.add_changes(spark, path, marked, 0)
    status.add_changes(spark, path, mails, 1)
    status.compact(spark, path)
    status.add_changes(spark, path, renamed, 2)
    status.add_changes(spark, path, renamed, 2)
    return status.with_status(_docs(spark, d).select(url), status.read_status(spark, path))


@query
def outbox(spark: SparkSession, d: str) -> DataFrame:
    marked = selection.mark_done(_letters(spark, d), selection.eligible(thresholds=THRESHOLDS))
    mails = selection.outbox(
        marked.withColumn("url", F.concat(F.lit("doc-"), "doc_id")), "N. N.", "letters", "cv.pdf", "references.pdf"
    )
    return mails


# --- the whole path -----------------------------------------------------------------------------
@query
def fit_report(spark: SparkSession, d: str) -> DataFrame:
    out = report.fit_report(
        _doc_records(spark, d), _terms(spark), stop_words=STOP_WORDS, extra_keywords=EXTRA_KEYWORDS
    )
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    return out.select(*rounded)


@query
def page_letters(spark: SparkSession, d: str) -> DataFrame:
    """Landed pages to a store in two overlapping batches, to scores, chosen rows, addresses and letters."""
    landed = _pages(spark, d)
    records = pages.page_records(
        landed, tags=["p"], company_markers=COMPANY_MARKERS, title_markers=TITLE_MARKERS, address_pattern=OWN_ADDRESS_PATTERN,
    )
    path = scratch_path(spark, "store")
    S.append_batch(spark, path, records.where("pos % 3 = 0"), 0)
    S.append_batch(spark, path, records, 1)
    texts = selection.letter_texts("Als Teamplayer.", "01.02.2025", "Hamburg", F.to_date(F.lit("2025-01-02")))
    out = report.page_letters(
        S.read_keyed_store(spark, path, records.schema), landed, _company_pages(landed), _terms(spark), texts, PAGE_THRESHOLDS,
        STOP_WORDS, extra_keywords=EXTRA_KEYWORDS, address_pattern=OWN_ADDRESS_PATTERN, card_pattern=CARD_PATTERN,
        card_marker="<nav>", facts_patterns=FACTS_PATTERNS, drop_prefixes=DROP_PREFIXES, size_words=SIZE_WORDS,
    )
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    return out.select(*rounded)


@query
def jaccard_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: documents ranked by Jaccard against a term list."""
    features, _ = _features(spark, d, "tasks", vectors=False)
    scores = scoring.jaccard(features).select("doc_id", "section", "jaccard")
    ranked = ranking.rank_average(stage(scores, "scores"), ["section"], "jaccard", ["doc_id"])
    return ranked.select("doc_id", F.round("jaccard", 6).alias("jaccard"), "rank")


QUERIES["page_scan"] = QUERIES.pop("page_scan_all")
