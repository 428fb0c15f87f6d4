"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers. Each number has a lookup table over quantile bins, learnt
by cyclic boosting: round after round, every feature in turn gets one shallow tree on
the residuals of the whole model, added at a small rate. The pairs of features whose
best two-way split explains most of what is left then get two-dimensional tables in the
same way. A score is the logistic of an intercept plus one table entry per feature and
pair, looked up for a whole batch at once.

Training reads at most TRAIN_ROWS labelled documents, so the model's fitting is a small
job on the driver; scoring is a projection that reads each text once and moves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexfit.llm.common import forget, held_out

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "words", "word_length", "symbols", "exclamations", "upper", "stops", "digits", "variety", "pair_variety",
    "stutter", "dup_lines", "lines", "non_ascii", "commonest", "bars", "line_words",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STOPS = np.frombuffer(b".,;:?", np.uint8)


def text_features(text: str | None) -> list[float]:
    """The features of one whole text, all 0 for a text without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    chars = len(raw) - count[[9, 10, 11, 12, 13, 32]].sum()
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n), chars / n, count[SYMBOLS].sum() / n, count[33] / n, upper / max(upper + lower, 1), count[STOPS].sum() / n,
        count[48:58].sum() / chars, len(seen) / n, len(set(zip(words, words[1:], strict=False))) / n, stutter / n,
        1 - len(set(lines)) / len(lines), len(lines) / n, count[128:].sum() / chars, max(seen.values()) / n, count[124] / n, np.log1p(n / len(lines)),
    ]


@dataclass
class Gam:
    """Bin edges, a table per feature, and a table per chosen pair of features on coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float = 0.0
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The steps of a tree on ordered bins, split where the gain is largest."""
    worth = lambda a, b: a * a / (b + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for part in parts:
            lo, hi = part
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
            gain = worth(gl, hl) + worth(gs - gl, hs - hl) - worth(gs, hs)
            if gain.max() > best[0]:
                best = (gain.max(), part, lo + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for lo, hi in parts:
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return step


def cross_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four blocks, and its steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = lambda c: (c, c[:, -1:] - c, c[-1:, :] - c, c[-1, -1] - c[:, -1:] - c[-1:, :] + c)
    blocks = list(zip(quads(cg), quads(ch), strict=True))
    gain = sum(a * a / (np.maximum(b, 0) + ridge) for a, b in blocks)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros_like(g)
    for (a, b), rows, cols in zip(blocks, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        step[rows, cols] = a[i, j] / (max(b[i, j], 0) + ridge)
    return float(gain.max()), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 60, ridge: float = 5.0) -> Gam:
    """Cyclic boosting of the single tables, then of the chosen pairs. ``y`` is 0 or 1, or between."""
    model = Gam([quantile_edges(x[:, f], bins) for f in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [quantile_edges(x[:, f], 8) for f in range(x.shape[1])]
    base = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(base / (1 - base)))
    total = np.full(len(y), model.intercept)
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = residual()
            step = rate * shallow_tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), leaves, ridge)
            table += step
            total += step[at[f]]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]

    def grid(f: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[k]) + 1)
        return np.bincount(cells[f] * shape[1] + cells[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = residual()
    ranked = sorted(((cross_cut(grid(f, k, g), grid(f, k, h), ridge)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for _, f, k in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[f]) + 1, len(model.coarse[k]) + 1)) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for (f, k), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residual()
            step = rate * cross_cut(grid(f, k, g), grid(f, k, h), ridge)[1]
            table += step
            total += step[cells[f], cells[k]]
    return model


def matrix(texts: pa.Array) -> np.ndarray:
    forget()
    return np.array([text_features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@F.arrow_udf(ArrayType(DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    return pa.array(list(matrix(texts)), pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Gam | None:
    """A model of ``labels.quality`` from at most ``most`` labelled documents outside the held-out quarter.

    They are the first by a hash of the id. Labels of a repeated id are averaged, and of its
    texts the first by hash counts; null ids and labels don't count. None if no labelled
    document is left.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marks = usable.groupBy("doc_id").agg(F.avg("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(marks), "doc_id")
    texts = texts.groupBy("doc_id", "_quality").agg(F.min("t")["text"].alias("text"))  # one row per id: at most ``most``
    rows = texts.select(features("text").alias("x"), "_quality").collect()
    if not rows:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r["_quality"] for r in rows], np.float64))


def quality_score(text: Column, model: Gam | None) -> Column:
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(texts)))

    return scored(text)


def apply(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, of which only doc_id and text are read.

    * null or empty text, or one without words: scored with all features 0
    * null doc_id: held out; repeated rows: a result each; a score equal to the threshold predicts 1
    * without any usable label every score is 1: nothing is known against a document
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
