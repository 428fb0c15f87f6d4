"""Expressions on single record fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions.text import strip


def job_id(url: Column) -> Column:
    """Characters -19 to -12 of the URL, cut as far as the URL is long."""
    n = F.length(url)
    return (
        F.when(n >= 19, F.substring(url, n - 18, F.lit(7)))
        .when(n > 12, F.substring(url, F.lit(1), n - 12))
        .when(n.isNotNull(), "")
    )


def any_literal(words: list[str]) -> str:
    """A pattern that matches any of the words, longest first so that none hides another."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def title_clean(title: Column, markers: list[str] = fx.GENDER_MARKERS) -> Column:
    return strip(F.regexp_replace(title, any_literal(markers), ""))


def title_blocked(title: Column, terms: list[str] = fx.TITLE_BLOCKLIST) -> Column:
    """True if the title holds any term, ignoring case; false for a missing title.
    The terms are patterns, as in the list's usual use."""
    return F.coalesce(title.rlike("(?iu)" + "|".join(terms)), F.lit(False))


def replace_multi(column: str, rules: list[tuple[str, str, list[str]]] = fx.REPLACEMENTS) -> Column:
    """All replacement rules that name this column, in the order of the rules."""
    out = F.col(column)
    for pattern, replacement, columns in rules:
        if column in columns:
            out = F.regexp_replace(out, pattern, replacement)
    return out.alias(column)


def replace_parts(parts: Column, rules: list[tuple[str, str, list[str]]] = fx.REPLACEMENTS) -> Column:
    """The rules for part_1, part_2 ... on an array of parts, of which all are kept."""

    def replaced(part: Column, i: Column) -> Column:
        for pattern, replacement, columns in rules:
            places = [int(c[5:]) - 1 for c in columns if c.startswith("part_")]
            if places:
                part = F.when(i.isin(places), F.regexp_replace(part, pattern, replacement)).otherwise(part)
        return part

    return F.transform(parts, replaced)


def safe_file_name(*fields: Column, prefix: str = "") -> Column:
    """Fields joined by '_', characters that file systems forbid replaced by '_'."""
    name = F.concat(F.lit(prefix), F.concat_ws("_", *fields))
    return F.regexp_replace(name, fx.FILE_NAME_FORBIDDEN, "_")


def address_lines(address: Column) -> Column:
    """One line per address item; two newlines if there is no address or no item."""
    lines = F.transform(F.when(F.size(address) > 0, address), lambda a: F.concat(strip(a), F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit("\n\n"))


def fill(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a text template; missing values become ''."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[
            F.lit(piece) if i % 2 == 0 else F.coalesce(fields[piece].cast("string"), F.lit(""))
            for i, piece in enumerate(pieces)
        ]
    )
