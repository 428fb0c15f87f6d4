"""Personal data by generated candidates and boosted trees.

Patterns of high recall propose spans that may overlap: the four base kinds, and looser
forms of them (addresses with the signs spelt out, in brackets or as words; numbers of any
grouping with seven digits or more; quads with spelt dots; digit groups with any separators,
also inside longer runs). Boosted trees judge each candidate by its format and the words
before it; a calibrated threshold per kind selects. Base spans always stand; a candidate is
added only if it overlaps none of them and no better candidate.

No table marks personal data, so the trees learn from what the texts themselves settle:
base spans and respelt copies of them against copies with a digit, sign or grouping broken
(dates, counts, plain runs) and candidates that no reading makes personal data. What may be
personal data in a form that the base does not know has no label and is not learnt from. All
candidates of the corpus count: equal ones are one row with a weight, so that neither hot
forms nor the corpus's size limit the fit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfit.llm.common import forget, grouped
from lexfit.session import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: No candidate below this probability is added, whatever the calibration says.
LEAST = 0.8

LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Looser forms; a kind's candidates may overlap another's.
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,5}", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w.+-])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
WORDS_FOR = re.compile(r"mail|contact|phone|tel|call|fax|mobile|card|visa|credit|address|host|server|\bip\b", re.I)
WORDS_AGAINST = re.compile(r"order|invoice|version|isbn|issn|serial|article|page|section|\bno\b|\bid\b|licen[sc]e|§", re.I)
#: Signs as words: "name at host dot com".
WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s(?:at|AT)\s[A-Za-z0-9-]{1,63}(?:(?:\.|\s(?:dot|DOT)\s)[A-Za-z0-9-]{1,63}){1,5}")
SPELT_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?|\sdot\s)[0-9]{1,3}){3}(?![0-9])", re.I)
#: Any separators; and groups as cards have them, wherever they begin in a longer run of groups.
WIDE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9])")
CARD_GROUPS = re.compile(r"(?<![0-9])(?=([0-9]{4}([\x20./_-])(?:[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{6}\2[0-9]{5}))(?![0-9]))")
NUMBER = re.compile(r"(?<![\w.+/-])(?:\+|\()?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![\w/-])")
DATE = re.compile(r"(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:[0-9]{4}|[0-9]{2}))(?![0-9])")
CARD_SHAPES = {(4, 4, 4, 4), (4, 6, 5)}
CONTEXT = 24


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: for each @ in turn, as much before it as is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


#: Every candidate has a digit, an at sign or a spelt one; as a word it is followed by a name with a dot.
MAY_HOLD = re.compile(r"[0-9]|@|[(\[{][aA][tT][)\]}]|\s(?:at|AT)\s[A-Za-z-]+(?:\.[A-Za-z-]|\s(?:dot|DOT)\s)")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Further candidates, overlapping ones included."""
    spans = [(m.start(), 0, m.end()) for m in SPELT.finditer(text)] if re.search(r"[(\[{]at[)\]}]", text, re.I) else []
    spans += [(m.start(), 0, m.end()) for m in WORDED.finditer(text)] if " at " in text or re.search(r"\s(?:at|AT)\s", text) else []
    spans += [(m.start(), 1, m.end()) for p in (IP, SPELT_QUAD) for m in p.finditer(text)]
    spans += [(m.start(), 2, m.end()) for p in (CARD, WIDE_CARD) for m in p.finditer(text) if 12 <= m.end() - m.start() <= 40]
    spans += [(m.start(1), 2, m.end(1)) for m in CARD_GROUPS.finditer(text)]
    spans += [(m.start(), 3, m.end()) for p in (LOCAL_PHONE, NUMBER) for m in p.finditer(text)]
    return list(dict.fromkeys(spans))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of the span, its neighbours, and the words just before it."""
    s, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = only_digits(s)
    groups = re.findall("[0-9]+", s)
    shape = tuple(map(len, groups))
    quad = kind == 1 and len(groups) == 4 and max(shape) < 10 and max(map(int, groups)) <= 255
    worded, following = kind == 0 and bool(re.search(r"\sat\s", s, re.I)), text[end : end + 1]
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(s)), float(len(digits)), float(sum(map(str.isalpha, s))), float(len(groups)),
        float(max(shape, default=0)), float(12 <= len(digits) <= 19 and luhn(digits)), float(quad),
        float("@" in s or bool(re.search(r"[(\[{]at[)\]}]", s, re.I))), float(bool(re.search(r"\.|[(\[{]dot[)\]}]", s, re.I))), float(s.startswith(("+", "00"))), float("(" in s),
        float(9 <= len(digits) <= 15), float(before[-1:].isalnum()), float(following.isalnum()), float(before[-1:] in tuple(".-+/=\"")),
        float(bool(WORDS_FOR.search(before))), float(bool(WORDS_AGAINST.search(before))), float(len(set(digits))),
        float(worded), float(kind == 0 and bool(re.search(r"\sdot\s|[(\[{]dot[)\]}]", s, re.I))), float(kind == 0 and bool(re.match(r"[A-Za-z]*[0-9._%+-]", s))),
        float(len(s) - len(s.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))), float(shape in CARD_SHAPES), float(s.startswith("0") and not s.startswith("00")),
        float(len(set(re.findall("[^0-9]+", s)))), float(bool(DATE.match(s))), float(shape[0] if shape else 0), float(shape[-1] if shape else 0), float(min(shape, default=0)),
        float(bool(re.search(r"[0-9][\x20./-]?$", before) or re.match(r"[\x20./-]?[0-9]", text[end : end + 2]))),
    ]


def variants(text: str, start: int, kind: int, end: int) -> Iterator[tuple[str, int, int, float]]:
    """A base span respelt (1) and broken (0), each as (text, start, end, label) in its context.

    Copies of other lengths are among them, so that a corpus whose addresses or numbers are
    all of one length does not teach the length.
    """
    s, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 2]
    made: list[tuple[str, str, str, float]] = []  # what stands before, the copy, what stands behind, label
    plus = lambda label, *copies: made.extend(("", c, "", label) for c in copies)
    digits = only_digits(s)
    if kind == 0:
        name, _, domain = s.partition("@")
        found = re.search("[A-Za-z]+", name)
        plain, host = found.group() if found else "look", domain.partition(".")[0]
        for who in {name, plain, plain[:3]}:
            for where in {domain, f"{host}.{domain}", domain[-5:].lstrip(".-") if "." in domain[-5:].strip(".-") else domain}:
                worded = where.replace(".", " dot ")
                plus(1.0, f"{who} (at) {where}", f"{who}(at){where}", f"{who}[at]{where.replace('.', '[dot]')}", f"{who} [at] {worded}", f"{who} at {worded}")
                plus(float(bool(re.match(r"[A-Za-z]*[0-9._%+-]", who))), f"{who} at {where}")
        plus(0.0, f"{name} (at) {host}", f"{plain} at 10.30")
    elif kind == 1:
        parts = s.split(".")
        high, low = [*parts[:3], "731"], ["999", *parts[1:]]
        plus(0.0, ".".join(high), ".".join(low), "[.]".join(high), " dot ".join(low))
        plus(1.0, *(sign.join(parts) for sign in ("[.]", "(dot)", " dot ")))
    elif kind == 2:
        broken = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        plus(0.0, s[:-1] + broken[-1], s[:11], f"{digits[:3]}/{digits[3:8]}/{digits[8:]}", f"{digits[:5]}.{digits[5:7]}.{digits[7:]}")
        if len(digits) in (15, 16):
            cuts = (0, 4, 8, 12, 16) if len(digits) == 16 else (0, 4, 10, 15)
            for sign in "/._ -":
                for d, label in ((digits, 1.0), (broken, 0.0)):
                    cut = sign.join(d[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
                    made += [("", cut, "", label), ("12 ", cut, "", label), ("", cut, " 2024", label)]
            made += [("", d, f" {digits[::-1]}", label) for d, label in ((digits, 1.0), (broken, 0.0))]
    elif kind == 3:
        code, _, rest = s[1:].partition(" ")
        whole = only_digits(rest)
        if len(whole) >= 7:
            plus(1.0, rest, f"00{s[1:]}")
            made += [("", s, " 190", 1.0), ("", rest, " 1111", 0.0), ("2024 ", rest, "", 0.0), ("", f"{whole[:4]} {whole[:4]} {whole[-4:]}", " 1111", 0.0)]
            for n in {whole, whole[:9], whole[:8]}:
                pairs = [("0" + n)[a : a + 2] for a in range(0, len(n) + 1, 2)]
                plus(1.0, f"00{code} {n[:2]} {n[2:]}", f"0{n[:2]} {n[2:]}", f"0{n[:3]}/{n[3:]}", f"0{n[:2]}-{n[2:5]}-{n[5:]}", *([" ".join(pairs)] if len(n) == 9 else []))
                plus(0.0, n, f"{n[:3]} {n[3:]}", " ".join(n), f"{n[:2]}.{n[2:5]}.{n[5:8]}")
            n = whole
            if len(n) == 10:
                plus(1.0, *(sign.join((n[:3], n[3:6], n[6:])) for sign in " -."))
            plus(0.0, f"{n[:2]}.{n[2:4]}.{n[3:7]}", f"0{n[1]}.0{n[2]}.{n[3:7]}", f"{n[:4]}-{n[4:6]}-{n[5:7]}", f"{n[:4]}-0{n[4]}-{n[5:7]} 0{n[0]}.{n[1:3]}", n[:7], rest[: len(rest) // 2])
    for lead, new, tail, label in made:
        yield left + lead + new + tail + right, len(left + lead), len(left + lead + new), label


class Taken:
    """Stretches that are spoken for; as they are disjoint and in order, one search finds an overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """A stretch that meets none."""
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def no_reading(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a candidate outside the base is settled: no respelling of personal data looks like it."""
    s = text[start:end]
    if kind == 0:
        return bool(WORDED.fullmatch(s)) and not re.search(r"\sdot\s", s, re.I) and not re.match(r"[A-Za-z]*[0-9._%+-]", s)
    if kind == 1:
        return any(len(g) > 9 or int(g) > 255 for g in re.findall("[0-9]+", s))
    if kind == 2:
        return not (12 <= len(digits := only_digits(s)) <= 19 and luhn(digits))
    return s[0] not in "+(0" and not LOCAL_PHONE.fullmatch(s) or bool(DATE.match(s))


def trace(text: str | None) -> Iterator[tuple[list[float], float]]:
    """(features, label) of the training candidates of a text."""
    if not text or not MAY_HOLD.search(text):
        return
    base = base_spans(text)
    for s, k, e in base:
        yield features(text, s, k, e), 1.0
        for new, a, b, label in variants(text, s, k, e):
            yield features(new, a, k, b), label
    taken = Taken(base)
    for s, k, e in loose_spans(text):
        if not taken.meets(s, e) and no_reading(text, s, k, e):
            yield features(text, s, k, e), 0.0


@dataclass
class Boosted:
    """Trees of depth three on binned features, one calibrated threshold per kind."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.raw_of(cells_of(x, self.edges))

    def raw_of(self, cells: np.ndarray) -> np.ndarray:
        total = np.full(len(cells), self.start)
        for feature, cut, leaf in self.trees:
            total += leaf[route(cells, feature, cut) - len(feature)]
        return total

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x))


DEPTH = 3


def route(cells: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The heap place of the leaf of each row; node 0 is the unused place before the root at 1."""
    node = np.ones(len(cells), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + (cells[np.arange(len(cells)), feature[node]] > cut[node])
    return node


def quantiles(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """``np.quantile`` of the values repeated by their counts; every value but the first if they are few."""
    order = np.argsort(values)
    values, ends = values[order], counts[order].cumsum()
    if len(values) <= bins:
        return values[1:]
    place = np.linspace(0, 1, bins + 1)[1:-1] * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, at, "right")] for at in (np.floor(place), np.ceil(place)))
    return np.unique(low + (high - low) * (place - np.floor(place)))


def bin_edges(shares: list[tuple[int, int, float, int]], bins: int = 16) -> list[np.ndarray]:
    """Edges of each feature from its (kind, feature, value, count) rows.

    Each kind has quantiles of its own, so that a kind with few candidates is told apart as finely as any.
    """
    kinds, fields, values, counts = (np.array(c) for c in zip(*shares, strict=True))
    edges = []
    for f in range(fields.max() + 1):
        mine = fields == f
        known, at = np.unique(values[mine], return_inverse=True)
        whole = quantiles(known, np.bincount(at, counts[mine]), bins)
        parts = [quantiles(values[mine & (kinds == k)], counts[mine & (kinds == k)], bins) for k in range(len(KINDS))]
        edges.append(whole if len(known) <= bins else np.unique(np.concatenate([whole, *parts])))
    return edges


def cells_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1)


def fit(edges: list[np.ndarray], cells: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 200, rate: float = 0.15, ridge: float = 2.0) -> Boosted:
    """Boost on four fifths of the candidates; calibrate by a logistic fit and per-kind thresholds on the rest.

    A row stands for ``n`` candidates of equal cells and label, of which a fifth, rounded
    up or down by a hash of the row, are for calibration.
    """
    up = np.array([zlib.crc32(c.astype(np.uint8).tobytes() + bytes([int(v)])) % 5 for c, v in zip(cells, y, strict=True)])
    held = (n + up) // 5
    p0 = (n @ y + 1) / (n.sum() + 2)
    model = Boosted(edges, float(np.log(p0 / (1 - p0))))
    all_cells, all_y = cells, y
    cells, target, weight = cells[n > held], y[n > held], (n - held)[n > held].astype(np.float64)
    total, width = np.full(len(target), model.start), max(map(len, edges)) + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (target - p), weight * p * (1 - p)
        feature, cut = np.zeros(2**DEPTH, np.int64), np.full(2**DEPTH, width)
        node = np.ones(len(target), np.int64)
        for _ in range(DEPTH):
            for at in np.unique(node):
                here = node == at
                part, g_here, h_here = cells[here], g[here], h[here]
                best = 1e-6
                for f in range(cells.shape[1]):
                    gs, hs = np.bincount(part[:, f], g_here, width).cumsum(), np.bincount(part[:, f], h_here, width).cumsum()
                    gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                    if gain.max() > best:
                        best, feature[at], cut[at] = float(gain.max()), f, int(gain.argmax())
            node = 2 * node + (cells[np.arange(len(cells)), feature[node]] > cut[node])
        leaf_of = node - 2**DEPTH
        leaf = rate * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + ridge)
        model.trees.append((feature, cut, leaf))
        total += leaf[leaf_of]
    test, weight = all_cells[held > 0], held[held > 0].astype(np.float64)
    raw, truth = model.raw_of(test), all_y[held > 0]
    for _ in range(50):  # Newton steps of the logistic calibration, held to a mild prior
        p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))
        off, h = weight * (truth - p), weight * p * (1 - p)
        g = np.array([(off * raw).sum() - 0.1 * (model.slope - 1), off.sum() - 0.1 * model.shift])
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        model.slope, model.shift = model.slope + float(step[0]), model.shift + float(step[1])
        if abs(step).max() < 1e-8:
            break
    p = model.calibrated(raw)
    for k in range(len(KINDS)):
        mine = test[:, k] == 1
        sure, at = np.unique(-p[mine], return_inverse=True)  # candidates of equal probability pass or fail together
        good, seen = np.bincount(at, (weight * truth)[mine], len(sure)).cumsum(), np.bincount(at, weight[mine], len(sure)).cumsum()
        precise = np.flatnonzero(good >= PRECISION * seen)
        if len(precise):
            model.thresholds[k] = max(LEAST, float(-sure[precise[-1]]))
    return model


def train(docs: DataFrame) -> Boosted | None:
    """Fit on all candidates of the whole corpus, equal ones as one row with their count; None without any."""

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in grouped(batches):
            got = Counter((tuple(x), y) for t in texts for x, y in trace(t))
            if got:
                cols = [pa.array([list(x) for x, _ in got], pa.list_(pa.float64())), pa.array([y for _, y in got]), pa.array(list(got.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["x", "y", "n"])

    rows = docs.select("text").where(F.col("text").rlike(MAY_HOLD.pattern)).mapInArrow(traced, "x array<double>, y double, n long")
    counted = stage(rows.groupBy("x", "y").agg(F.sum("n").alias("n")), "pii-candidates")
    kind = F.array_position(F.slice("x", 1, len(KINDS)), F.lit(1.0)) - 1
    shares = counted.select(kind.alias("k"), F.posexplode("x").alias("f", "v"), "n").groupBy("k", "f", "v").agg(F.sum("n").alias("n")).collect()
    if not shares:
        return None
    edges = bin_edges([tuple(r) for r in shares])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                cells = pa.array([c.tobytes() for c in cells_of(x, edges).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([cells, batch.column("y"), batch.column("n")], ["cells", "y", "n"])

    # trees see cells only, so candidates of equal cells are one row to them, too
    got = counted.mapInArrow(binned, "cells binary, y double, n long").groupBy("cells", "y").agg(F.sum("n").alias("n")).toArrow().sort_by([("cells", "ascending"), ("y", "ascending")])
    cells = np.frombuffer(b"".join(got["cells"].to_pylist()), np.uint8).reshape(got.num_rows, -1)
    return fit(edges, cells.astype(np.int64), got["y"].to_numpy(), got["n"].to_numpy())


def find(text: str | None, model: Boosted | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of one whole text, each ordered by start, then kind."""
    if not text or not MAY_HOLD.search(text):
        return [], []
    base = base_spans(text)
    chosen = list(base)
    taken = Taken(base)
    loose = [c for c in loose_spans(text) if not taken.meets(c[0], c[2])] if model else []
    if loose:
        p = model.probability(np.array([features(text, s, k, e) for s, k, e in loose]))
        for i in np.argsort(-p, kind="stable").tolist():
            a, kind, b = loose[i]
            if p[i] >= model.thresholds[kind] and not taken.meets(a, b):
                chosen.append(loose[i])
                taken.add(a, b)
    return base, sorted(chosen)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, free = [], 0
    for s, k, e in spans:
        if s >= free:
            out += [text[free:s], f"[{KINDS[k].upper()}]"]
        free = max(free, e)
    return "".join(out) + text[free:]


def apply(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """The columns of ``docs`` named doc_id and text, plus n_email, n_ip, n_card, n_phone, base, spans and redacted.

    * null or empty text: no spans; null stays null in ``redacted``
    * null doc_id: like any other row; repeated rows: a result each; texts of any length are searched whole
    * ties in probability go to the candidate proposed first; without a model only base spans are found
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches):
            found = [find(t, model) for t in texts]
            counts = [pa.array([sum(k == n for _, k, _ in base) for base, _ in found], pa.int64()) for n in range(len(KINDS))]
            strings = [pa.array([joined(f[i]) for f in found], pa.string()) for i in (0, 1)]
            clean = pa.array([None if t is None else redacted(t, f[1]) for t, f in zip(texts, found, strict=True)], pa.string())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *strings, clean], names)

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact_column(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """``docs`` with its text redacted and n_chars, where it has one, brought in line."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([None if (t := x.as_py()) is None else redacted(t, find(t, model)[1]) for x in texts], pa.string())

    new = docs.withColumn("text", clean("text"))
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
