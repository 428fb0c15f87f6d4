"""Suffix arrays by induced sorting, and permuted longest common prefixes.

A string's leftmost-smaller substrings are ranked, the string of their ranks is sorted by
the same method, level after level, and all suffixes are induced from that order: with
few symbols bucket by bucket on numpy, in waves of all suffixes found so far, and with
many by a scan each way over lists. Both are linear in the text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last symbol is unique and least."""
    change = np.flatnonzero(text[:-1] != text[1:])
    rising = text[change] < text[change + 1]
    return np.append(np.repeat(rising, np.diff(change, prepend=-1)), True)


def place(target: np.ndarray, slots: np.ndarray, symbols: np.ndarray, values: np.ndarray, step: int) -> None:
    """Put values, in order, at the next free place of their symbol's bucket, forwards or backwards."""
    if len(values) == 1:
        s = symbols[0]
        target[slots[s] - (step < 0)] = values[0]
        slots[s] += step
        return
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    sizes = np.diff(np.append(first, len(ranked)))
    rank = np.arange(len(ranked)) - np.repeat(first, sizes)
    target[slots[ranked] - (step < 0) + step * rank] = values[order]
    slots[ranked[first]] += step * sizes


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    n = len(text)
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    larger = np.bincount(text[~smaller], minlength=symbols)
    seeds = np.bincount(text[lms], minlength=symbols)
    sa = np.full(n, -1, np.int64)
    place(sa, ends - seeds, text[lms], lms, 1)
    used = np.flatnonzero(sizes)

    heads = starts.copy()
    for c in used.tolist():
        at = starts[c]
        while at < heads[c]:
            upto = heads[c]
            before = sa[at:upto] - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                place(sa, heads, text[before], before, 1)
            at = upto
        if seeds[c]:
            before = sa[ends[c] - seeds[c] : ends[c]] - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                place(sa, heads, text[before], before, 1)

    tails = ends.copy()
    tails[text[-1]] -= 1  # the last symbol's own suffix
    sa[tails[text[-1]]] = n - 1
    for c in used[::-1].tolist():
        at = ends[c]
        while at > tails[c]:
            downto = tails[c]
            before = sa[downto:at][::-1] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                place(sa, tails, text[before], before, -1)
            at = downto
        before = sa[starts[c] : starts[c] + larger[c]][::-1] - 1
        before = before[before >= 0]
        before = before[smaller[before]]
        if len(before):
            place(sa, tails, text[before], before, -1)
    return sa


def induce_loosely(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> list[int]:
    """The same for a string of many symbols: a scan each way over lists, as its buckets hold too little for waves."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    before = np.append(text[-1], text[:-1])
    ahead = np.where(np.append(True, smaller[:-1]), -1, before)  # the symbol before i where that suffix is a larger one
    behind = np.where(np.append(False, smaller[:-1]), before, -1)
    ahead, behind = [*ahead.tolist(), -1], [*behind.tolist(), -1]  # place n: nothing yet
    sa = np.full(n, n, np.int64)
    place(sa, ends.copy(), text[lms[::-1]], lms[::-1], -1)
    sa, heads, tails = sa.tolist(), [0, *ends[:-1].tolist()], (ends - 1).tolist()
    for i in sa:
        if (c := ahead[i]) >= 0:
            sa[heads[c]] = i - 1
            heads[c] += 1
    for i in reversed(sa):
        if (c := behind[i]) >= 0:
            sa[tails[c]] = i - 1
            tails[c] -= 1
    sa[0] = n - 1
    return sa


def substring_names(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """The rank of each substring among all: a few symbols at a time, as long as a substring has more.

    A leftmost-smaller substring that begins another one comes after it, so an end
    counts as more than any symbol.
    """
    bits = int(symbols).bit_length()
    step, end = max(1, 63 // bits), (1 << bits) - 1
    names = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    at = 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for k in range(at, at + step):
            inside = k < lengths[live]
            word = word << bits | np.where(inside, text[np.where(inside, starts[live] + k, 0)], end)
        order = np.lexsort((word, names[live]))
        group, word = names[live][order], word[order]
        fresh = np.append(True, group[1:] != group[:-1])
        other = fresh | np.append(True, word[1:] != word[:-1])
        # a name is the number of substrings before its group, so later words only split groups
        first = np.flatnonzero(fresh)
        within = np.flatnonzero(other)[np.cumsum(other) - 1] - np.repeat(first, np.diff(np.append(first, len(live))))
        names[live[order]] = group + within
        at += step
        live = live[lengths[live] >= at]  # one that ends here still goes after the longer ones
    return np.unique(names, return_inverse=True)[1]


def leftmost_smaller(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The types of all suffixes, the leftmost-smaller places, and the lengths of their substrings."""
    smaller = smaller_types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, lms, np.diff(np.append(lms, len(text) - 1)) + 1


def ordered(lms: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Leftmost-smaller suffixes in order, from the names of their substrings."""
    count = int(names.max()) + 1
    return lms[np.argsort(names) if count == len(lms) else plain_suffix_array(names, count)]


def plain_suffix_array(text: np.ndarray | list[int], symbols: int) -> list[int]:
    """For strings of many symbols, as those of names are: all integers below ``symbols``, the last one unique and least."""
    text = np.asarray(text, np.int64)
    smaller, lms, lengths = leftmost_smaller(text)
    if len(lms) > 1:
        lms = ordered(lms, substring_names(text, lms, lengths, symbols))
    return induce_loosely(text, smaller, lms, symbols)


class PrefixHash:
    """Hashes of substrings by differences of a running polynomial."""

    def __init__(self, symbols: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        self.down = down
        self.total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up, out=self.total[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.total[start + length] - self.total[start]) * self.down[start]


def suffix_array(text: np.ndarray, symbols: int, hashes: PrefixHash) -> np.ndarray:
    """For strings of few symbols, the last one unique and least; ``hashes``: over the same text."""
    smaller, lms, lengths = leftmost_smaller(text)
    if len(lms) > 1:
        _, first, which = np.unique(hashes.of(lms, lengths), return_index=True, return_inverse=True)
        lms = ordered(lms, substring_names(text, lms[first], lengths[first], symbols)[which])
    return induce(text, smaller, lms, symbols)


def common_prefixes(text: np.ndarray, sa: np.ndarray, hashes: PrefixHash, room: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with its predecessor in the suffix array, at most the room of either.

    In text order a prefix is one shorter than the one before it wherever both positions
    follow equal symbols inside the room; only the others are measured, by halving steps on hashes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    known = before >= 0
    follows = np.zeros(n, bool)
    follows[1:] = known[1:] & known[:-1] & (room[:-1] > 0) & (before[1:] > 0) & (text[:-1] == text[before[1:] - 1]) & (before[:-1] == before[1:] - 1)
    measure = np.flatnonzero(known & ~follows)
    other = before[measure]
    limit = np.minimum(room[measure], room[other])
    size = np.zeros(len(measure), np.int64)
    step = 1 << int(limit.max(initial=1)).bit_length()
    while step:
        fits = np.flatnonzero(size + step <= limit)
        same = hashes.of(measure[fits] + size[fits], step) == hashes.of(other[fits] + size[fits], step)
        size[fits[same]] += step
        step >>= 1
    found = np.zeros(n, np.int64)
    found[measure] = size
    source = np.maximum.accumulate(np.where(~follows, np.arange(n), 0))
    return np.where(known, np.maximum(found[source] - (np.arange(n) - source), 0), 0)
