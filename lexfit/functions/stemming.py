"""German stemming of whole texts.

Both stemmers take a string of lower-case tokens with single blanks between them
and rewrite every token at once: published rules are patterns over the whole
text, anchored at token edges. That keeps stemming a narrow projection in
generated code. The usual alternative - explode, join a stem dictionary, regroup
- would shuffle every token of the corpus, and its join key is as skewed as
language is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyäöü"
# What \s stands for, letter by letter: a class of single letters is one table look-up.
BLANKS = r" \t\n\x0B\f\r"
VOWEL = f"[{VOWELS}]"
NON_VOWEL = f"[^{BLANKS}{VOWELS}]"
CAPITAL = "\x01"


def _lead(text: Column) -> Column:
    """Give every token a blank in front: a literal first character is the cheapest
    anchor for a pattern search."""
    return F.concat(F.lit(" "), text)


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each replacement in turn: plain searches, far cheaper than a look-up for each letter."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _cut_ends(text: Column, ends: str) -> Column:
    """``ends``, a pattern over letters from right to left, cut off the end of each token.

    The text is turned round for it, so that every search starts at a blank and goes through
    the end of a token only.
    """
    cut = F.regexp_replace(_lead(F.reverse(text)), f" (?:{ends})", " ")
    return F.reverse(F.substring(cut, 2, 2**31 - 1))


def snowball_german(text: Column) -> Column:
    """German Snowball (Porter's published rules) on every token."""
    t = F.replace(F.lower(_lead(text)), F.lit("ß"), F.lit("ss"))

    # u and y between vowels count as consonants: written as capitals. A letter just
    # capitalised is no vowel for the next, so a u or y right behind it is passed over.
    t = F.regexp_replace(t, rf"[uy](?<={VOWEL}[uy])(?={VOWEL})[uy]?+", f"{CAPITAL}$0")
    t = _replace_all(t, [(CAPITAL + "u", "U"), (CAPITAL + "y", "Y")])

    # All patterns from here on read from right to left. R1 starts after the first non-vowel that
    # follows a vowel and leaves at least three letters in front, R2 after the next such place
    # behind it. So an ending lies in R1 if what is left of it has one such place and three letters.
    r1 = rf"(?=\S{{3}})(?={VOWEL}*+{NON_VOWEL}++{VOWEL})"
    r2 = f"(?={VOWEL}*+{NON_VOWEL}++{VOWEL}++{NON_VOWEL}++{VOWEL})"
    # Step 1, inflections in R1: en, es, e and an s after nis; ern, em, er, en, es, e; s.
    step1 = f"(?:[ns]?es(?=sin)|(?:nre|[mrns]e|e){r1}|s(?=[bdfghklmnrt]){r1})"
    # Step 2, comparison and verb endings in R1: est, en, er; st.
    step2 = rf"(?:(?:tse|[nr]e){r1}|ts(?=[bdfghklmnt]\S{{3}}){r1})"
    # Step 3, derivations in R2: end, ung; isch, ig, ik; lich, heit; keit.
    endings = "|".join(
        [
            f"(?:dne|gnu){r2}(?:gi(?!e){r2})?+",
            f"(?:hcsi|gi|ki)(?!e){r2}",
            f"(?:hcil|tieh){r2}(?:[rn]e{r2})?+",
            f"tiek{r2}(?:(?:hcil|gi){r2})?+",
        ]
    )
    step3 = f"(?:{endings})"
    t = _cut_ends(t, f"{step1}{step2}?+{step3}?+|{step2}{step3}?+|{step3}")

    return F.ltrim(_replace_all(t, [*zip("äöüUY", "aouuy")]))


# Stand-ins for letter groups that count as one letter.
CISTEM_SYMBOLS = [("sch", "$"), ("ei", "%"), ("ie", "&")]


def cistem(text: Column) -> Column:
    """CISTEM (Weissweiler and Fraser, 2017) on every token of a lower-cased text."""
    t = _replace_all(F.lower(_lead(text)), [*zip("äöü", "aou"), ("ß", "ss")])
    t = F.regexp_replace(t, r" ge(?=\S{4})", " ")
    t = _replace_all(t, CISTEM_SYMBOLS)
    # The second of two equal letters is no ending. Endings of one letter and the e and n of those
    # of two are all that matters: a second m, r or d follows no e or n anyway.
    t = _replace_all(t, [(letter * 2, letter + "*") for letter in "tesn"])

    # The strip loop: em, er, nd while four letters stay, t, e, s, n while three stay.
    # Possessive repeats keep long runs off the Java stack.
    t = _cut_ends(t, r"(?:[tesn](?=\S{3})|(?:[mr]e|dn)(?=\S{4}))++")

    t = _replace_all(t, [(letter + "*", letter * 2) for letter in "tesn"])
    return F.ltrim(_replace_all(t, [(symbol, group) for group, symbol in reversed(CISTEM_SYMBOLS)]))
