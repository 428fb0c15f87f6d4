"""Text normalisation as column expressions.

All of them work on whole strings with built-in expressions that stay inside
whole-stage codegen; none needs a shuffle or a Python worker.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfit import fixed_values as fx

# Unicode letters, numbers and the underscore: what Python's \w covers. Java's
# \w is ASCII by default and its Unicode form also takes in combining marks.
WORD = r"\p{L}\p{N}_"
# Inside a class, with the (?U) flag: the characters Python treats as whitespace.
SPACE = r"\s\x1c-\x1f"
# A Unicode word boundary written out, since Java's own \b differs from \w.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and strip the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def clean_text(text: Column, newline_as_space: bool = False) -> Column:
    """Punctuation to blanks, newlines away, other symbols away, umlauts in two
    letters, lower case. ``newline_as_space`` keeps the words at a line end apart.
    """
    # translate() maps the punctuation in one pass and drops what has no partner.
    blanks = " " * (len(string.punctuation) + newline_as_space)
    out = F.translate(text, string.punctuation + "\n", blanks)
    # Only letters, digits and blanks are left of printable ASCII: the cheap first half of
    # the class spares them the property tests.
    out = F.regexp_replace(out, rf"(?U)[[^ -~]&&[^{WORD}{SPACE}]]+", "")
    for letter, pair in fx.UMLAUTS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.lower(out)


def tokenize(text: Column) -> Column:
    """Split at whitespace runs; no empty tokens."""
    return F.array_remove(F.split(text, rf"(?U)[{SPACE}]+"), "")


def tokens_to_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def first_word(text: Column) -> Column:
    """The first word of a cleaned term; null if there is none."""
    return F.get(tokenize(text), F.lit(0))


def remove_stopwords(tokens: Column, words: list[str]) -> Column:
    """Drop listed tokens; order and repeats stay. The list is a query literal,
    looked up as a hash set; for lists kept as tables see ``drop_listed_tokens``.
    """
    return F.filter(tokens, lambda t: ~t.isin(list(words))) if words else tokens


def vectorizer_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters (the usual count-vectoriser rule)."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{WORD}]{{2,}})"), F.lit(1))


def char_trigrams(text: Column) -> Column:
    """All overlapping runs of three characters, found in one linear scan."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1))


def extract_emails(text: Column) -> Column:
    """All mail addresses, comma-joined; '' if there is none."""
    found = F.regexp_extract_all(text, F.lit(f"{EDGE}({fx.EMAIL_PATTERN}){EDGE}"), F.lit(1))
    # Most texts hold no '@': skip the pattern search for them.
    return F.when(F.contains(text, F.lit("@")), F.array_join(found, ",")).when(text.isNotNull(), "")


def tidy_text(text: Column) -> Column:
    """Double newline to a blank, then strip."""
    return strip(F.replace(text, F.lit("\n\n"), F.lit(" ")))
