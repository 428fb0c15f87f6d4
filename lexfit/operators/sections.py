"""Section lookup: a short heading cell decides what the next cell is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfit import fixed_values as fx
from lexfit.functions.text import EDGE


def keyword_pattern(keywords: list[str]) -> str:
    """Whole words, any case; ``.`` in a keyword does not cross a line end."""
    return f"(?iud){EDGE}(?:{'|'.join(keywords)}){EDGE}"


def section_lookup(
    parts: Column,
    keywords: list[str],
    start: int = 0,
    guarded: dict[int, list[str]] | None = None,
    peek_keywords: list[str] | None = None,
    sentinel: str | None = fx.MISSING_SECTION,
) -> Column:
    """The cell after the first heading cell.

    A heading cell is shorter than 100 characters and holds a keyword. ``guarded``
    adds keywords that count in single cells only (0-based). ``peek_keywords`` count
    only if the start of the next cell matches ``keywords``. Without any heading cell
    the result is ``sentinel`` if a short cell was seen, else null.
    """
    words = keyword_pattern(keywords)
    guarded = guarded or {}

    def is_heading(cell: Column, i: Column) -> Column:
        hit = cell.rlike(words)
        for k, extra in guarded.items():
            hit = hit | ((i == k) & cell.rlike(keyword_pattern(extra)))
        if peek_keywords:
            following = F.substring(F.get(parts, i + 1), 1, fx.NEXT_CELL_PREFIX)
            peek = cell.rlike(keyword_pattern(peek_keywords)) & following.rlike(words)
            hit = hit | peek
        return (F.length(cell) < fx.HEADING_LIMIT) & (i >= start) & F.coalesce(hit, F.lit(False))

    hits = F.transform(parts, lambda cell, i: F.coalesce(is_heading(cell, i), F.lit(False)))
    cells = F.slice(parts, F.lit(start + 1), F.size(parts)) if start else parts
    short = F.exists(cells, lambda cell: F.length(cell) < fx.HEADING_LIMIT)

    def value(position: Column) -> Column:
        # 1-based position of the heading: also the next cell's 0-based index.
        return F.when(position > 0, F.get(parts, position.cast("int"))).when(
            F.coalesce(short, F.lit(False)), F.lit(sentinel)
        )

    # A one-item array binds the position, so that the walk is evaluated once.
    return F.get(F.transform(F.array(F.array_position(hits, F.lit(True))), value), F.lit(0))


def _list(section: str, number: int, extra: dict | None) -> list[str]:
    return fx.SECTION_KEYWORDS[section, number] + list((extra or {}).get((section, number), []))


def scan_cells(parts: Column, *record: Column) -> Column:
    """The cells that a lookup walks through: fields of the record, one cell each, then its parts.

    Hand the number of fields to the lookups, whose positions count from the first part. A
    field that is missing is a cell that is passed over.
    """
    return F.concat(F.array(*[c.cast("string") for c in record]), parts) if record else parts


def section_tasks(cells: Column, extra: dict | None = None, fields: int = 0) -> Column:
    """'Expects' phrases count in the first two parts only."""
    expects = _list("tasks", 2, extra)
    return section_lookup(cells, _list("tasks", 1, extra), guarded={fields: expects, fields + 1: expects})


def section_profile(cells: Column, extra: dict | None = None, fields: int = 0) -> Column:
    """The walk is the same with and without record fields; ``fields`` is there for symmetry."""
    return section_lookup(cells, _list("profile", 1, extra))


def section_benefits(cells: Column, extra: dict | None = None, fields: int = 0) -> Column:
    """No ad opens with its benefits: the walk starts at part 2; 'expects' phrases
    count in part 6 only, the stock heading only if the next cell speaks of benefits.
    """
    return section_lookup(
        cells,
        _list("benefits", 1, extra),
        start=fields + 1,
        guarded={fields + 5: _list("benefits", 2, extra)},
        peek_keywords=_list("benefits", 3, extra),
    )


def section_contact(cells: Column, extra: dict | None = None, fields: int = 0) -> Column:
    """Starts at part 6 and leaves the value missing if there is no heading."""
    return section_lookup(cells, _list("contact", 1, extra), start=fields + 5, sentinel=None)
