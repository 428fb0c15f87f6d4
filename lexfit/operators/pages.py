"""From landed HTML pages to ad records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions import html as H
from lexfit.operators.joins import frequent, spread_left_join
from lexfit.session import stage


def search_plan(
    terms: DataFrame, pages: int, place: Column, radius: Column, base: str
) -> DataFrame:
    """One request URL per search term and result page.

    The page numbers are generated inside each row, so there is no cross join.
    """
    numbered = terms.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    path = F.format_string(base + fx.SEARCH_PATH, F.col("term"), place, radius, F.col("page"))
    return numbered.withColumn("request_url", path)


def extract_links(pages: DataFrame, base: str) -> DataFrame:
    """One row per link and page, with its position."""
    found = pages.select(
        "page_id", F.posexplode_outer(H.links(F.col("html"), base)).alias("pos", "link")
    )
    return found.where("link is not null")


def links_per_page(pages: DataFrame, base: str) -> DataFrame:
    """Number of links per page, empty pages included.

    A page is one row, so the count is a projection; nothing has to be grouped.
    """
    return pages.select("page_id", F.size(H.links(F.col("html"), base)).alias("n_links"))


def top_n_per_page(pages: DataFrame, base: str, n: int) -> DataFrame:
    """The first ``n`` links of each page (fewer where a page has fewer)."""
    first = F.slice(H.links(F.col("html"), base), 1, n)
    found = pages.select("page_id", F.posexplode_outer(first).alias("pos", "link"))
    return found.where("link is not null")


def address_resolve(
    ads: DataFrame,
    company_pages: DataFrame,
    address_pattern: str = fx.ADDRESS_PATTERN,
    card_pattern: str = r"<a [^>]*href=['\"]?([^'\" >]+)",
    card_marker: str = fx.COMPANY_CARD_MARKER,
    facts_patterns: list[str] | None = None,
    drop_prefixes: list[str] = fx.ADDRESS_DROP_PREFIXES,
    size_words: list[str] = fx.ADDRESS_SIZE_WORDS,
) -> DataFrame:
    """Address of each ad: its own location block, else the facts block of the company
    page its card links to (first layout that fits), else an empty list.

    ``company_pages(link, html)`` is unique on link. Both sides shrink to a few short
    columns, each page read once, before they meet; ads that need no company page stay spread out, and a
    link that many ads share is looked up through a broadcast of bounded size.
    """
    html = F.col("html")
    own = H.address_items(H.first_group(html, address_pattern))
    link = F.when(F.contains(html, F.lit(card_marker)), H.first_group(html, card_pattern))
    left = stage(ads.select("page_id", own.alias("own_address"), link.alias("link")), "ads")

    blocks = [H.first_group(F.col("html"), p) for p in facts_patterns or ["(?s)(.+)"]]
    facts = H.address_from_facts(F.coalesce(*blocks), drop_prefixes, size_words)
    right = stage(company_pages.select("link", facts.alias("facts_address")), "companies")

    needed = F.col("own_address").isNull()
    hot_links = frequent(left.where(needed & F.col("link").isNotNull()), ["link"])
    hot = right.join(F.broadcast(hot_links), "link", "left_semi")
    joined = spread_left_join(left, right, ["link"], needed, hot)
    address = F.coalesce("own_address", "facts_address", F.array().cast("array<string>"))
    return joined.select("page_id", address.alias("address"))


def page_records(
    pages: DataFrame,
    batch_no: int = 0,
    tags: list[str] = fx.HEADING_TAGS,
    company_markers: tuple[str, str] = fx.COMPANY_MARKERS,
    title_markers: tuple[str, str] = fx.TITLE_MARKERS,
    address_pattern: str = fx.ADDRESS_PATTERN,
    intro_mark: str = fx.INTRO_MARK,
) -> DataFrame:
    """Raw ad records of a batch of pages, one narrow projection."""
    html = F.col("html")
    parts = H.drop_intro(H.page_parts(html, tags), html, intro_mark)
    return pages.select(
        "url",
        H.between(html, title_markers).alias("title"),
        H.between(html, company_markers).alias("company"),
        H.address_items(H.first_group(html, address_pattern)).alias("address"),
        parts.alias("parts"),
        F.lit(batch_no).cast("bigint").alias("batch_no"),
        F.col("page_id").alias("pos"),
    )
