"""Reading HTML text with column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions.text import squeeze, strip

# A Unicode noncharacter marks cut points; it cannot occur in interchanged text.
CUT = "\ufdd0"
TAG = rf"<[^<{CUT}]+?>"


def links(html: Column, base: str, drop_prefix: str = "https://") -> Column:
    """All href values in page order, absolute ones dropped, the site base put in front."""
    found = F.regexp_extract_all(html, F.lit("href=['\"]?([^'\" >]+)"), F.lit(1))
    kept = F.filter(found, lambda u: ~u.startswith(drop_prefix))
    return F.transform(kept, lambda u: F.concat(F.lit(base), u))


def between(html: Column, markers: tuple[str, str]) -> Column:
    """The text between the first two markers met (either kind); null if none is there."""
    return F.get(F.split(html, "|".join(markers), 3), F.lit(1))


def first_group(html: Column, pattern: str) -> Column:
    """Group 1 of the first match, ``.`` stopping at a newline only; null without a match."""
    pattern = "(?d)" + pattern
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def address_items(text: Column) -> Column:
    """Split at commas, strip, drop the last item (the country)."""
    items = F.transform(F.split(text, ","), strip)
    return F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))


def _not_starting(prefix: str):
    return lambda word: ~word.startswith(prefix)


def address_from_facts(
    html: Column,
    drop_prefixes: list[str] = fx.ADDRESS_DROP_PREFIXES,
    size_words: list[str] = fx.ADDRESS_SIZE_WORDS,
) -> Column:
    """Address items from a facts block: tags out, listed words out, everything from
    the first size word on cut off (the words are tried in the order given), the rest
    split at commas.
    """
    words = F.split(F.regexp_replace(html, "<[^<]+?>", ""), " ")
    for prefix in drop_prefixes:
        words = F.filter(words, _not_starting(prefix))
    cut = F.coalesce(
        *[F.nullif(F.array_position(words, w), F.lit(0)) for w in size_words],
        F.size(words) + F.lit(1).cast("bigint"),
    )
    kept = F.slice(words, F.lit(1), (cut - 1).cast("int"))
    items = F.transform(F.split(F.array_join(kept, " "), ","), strip)
    return F.array_remove(items, "")


def mark_headings(html: Column, tags: list[str] = fx.HEADING_TAGS) -> Column:
    """Put a cut mark before and after each heading of the first listed tag that occurs."""
    marked = html
    for tag in reversed(tags):
        pattern = f"(?d)(<{tag}.*?>.*?</{tag}>)"
        cut = F.regexp_replace(html, pattern, f"{CUT}$1{CUT}")
        marked = F.when(F.contains(html, F.lit(f"<{tag}")), cut).otherwise(marked)
    return marked


def heading_split(html: Column, tags: list[str] = fx.HEADING_TAGS) -> Column:
    """Raw parts: text before the first heading, heading, text, heading, ..."""
    return F.split(mark_headings(html, tags), CUT)


def strip_tags(html: Column) -> Column:
    """Tags to blanks, whitespace runs to one blank."""
    return squeeze(F.regexp_replace(html, TAG, " "))


def page_parts(html: Column, tags: list[str] = fx.HEADING_TAGS) -> Column:
    """Headings and texts in turn, without tags and without empty parts.

    Tags and whitespace are handled on the marked page as one string; that gives the
    same parts as handling each part by itself, and stays in generated code.
    """
    text = squeeze(F.regexp_replace(mark_headings(html, tags), TAG, " "))
    return F.array_remove(F.split(text, f" ?{CUT} ?"), "")


def drop_intro(
    parts: Column, html: Column, mark: str = fx.INTRO_MARK, limit: int = fx.INTRO_LIMIT
) -> Column:
    """Drop the first part if ``mark`` occurs more than ``limit`` times in the page."""
    times = F.size(F.split(html, re.escape(mark))) - 1
    return F.when(times > limit, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0)))).otherwise(parts)


def part_columns(parts: Column, k: int = fx.WIDE_PARTS) -> list[Column]:
    """Columns part_1..part_k, '' where the list is shorter, then n_parts and part_rest,
    an array of all parts after the k-th."""
    columns = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"part_{i + 1}") for i in range(k)]
    rest = F.slice(parts, F.lit(k + 1), F.greatest(F.size(parts), F.lit(0)))
    return [*columns, F.greatest(F.size(parts), F.lit(0)).cast("bigint").alias("n_parts"), rest.alias("part_rest")]
