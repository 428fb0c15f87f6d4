"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 2-, 3- and 4-grams of its lower-cased words with a space
on either side, hashed into buckets. Each bucket has an embedding; a text is the mean
of its subwords' embeddings, and a linear softmax over it gives the languages'
probabilities. Embeddings and softmax are trained together by stochastic gradient
descent in numpy, then calibrated by one temperature and a rejection threshold.

As everything after the mean is linear, scoring a text is its bucket counts times a
table of bucket by language. Training reads the subword counts of at most TRAIN_ROWS
texts; scoring reads each whole text once and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfit.llm.common import grouped, held_out
from lexfit.session import stage

BUCKET_BITS = 14
DIMENSIONS = 16
TRAIN_ROWS = 3_000
#: Ids of each language that are learnt from besides, however rare it is.
LEAST_ROWS = 50
UNKNOWN = "und"
GRAMS = (2, 3, 4)
#: Odd multipliers of the hash, one per place in a gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subword_counts(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32) + np.uint32(1)
    counts = np.zeros(1 << bits, np.int64)
    if not words:
        return counts
    hashed = raw * MULTIPLIERS[0]
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + raw[n - 1 :] * MULTIPLIERS[n - 1]
        if n in GRAMS:
            counts += np.bincount((hashed * MULTIPLIERS[3]) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


@dataclass
class LanguageModel:
    """``table``: bucket by language, embeddings times softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.table) / np.maximum(counts.sum(-1, keepdims=True), 1) + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[list[int], list[int], str]], bits: int = BUCKET_BITS, dims: int = DIMENSIONS, epochs: int = 12, batch: int = 32, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on (buckets, counts, language) rows; every fifth row is for calibration."""
    languages = sorted({lang for _, _, lang in rows})
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << bits, dims)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dims, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    squares = [np.full_like(a, 1e-8) for a in (embed, weights, bias)]

    def dense(part: list[int]) -> np.ndarray:
        x = np.zeros((len(part), 1 << bits), np.float32)
        for k, i in enumerate(part):
            x[k, rows[i][0]] = rows[i][1]
        return x / np.maximum(x.sum(1, keepdims=True), 1)

    y = np.eye(len(languages), dtype=np.float32)[[languages.index(lang) for _, _, lang in rows]]
    learn = [i for i in range(len(rows)) if i % 5] or list(range(len(rows)))
    check = [i for i in range(len(rows)) if i % 5 == 0]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(learn).tolist()
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = dense(part)
            hidden = x @ embed
            error = (softmax(hidden @ weights + bias) - y[part]) / len(part)
            grads = (x.T @ (error @ weights.T), hidden.T @ error, error.sum(0))
            for value, square, grad in zip((embed, weights, bias), squares, grads, strict=True):
                square += grad * grad
                value -= step * grad / np.sqrt(square)
    table = embed @ weights
    logits = np.concatenate([dense(check[at : at + 256]) @ table for at in range(0, len(check), 256)]) + bias
    truth = y[check]
    loss = lambda t: -np.log(np.maximum((softmax(logits / t) * truth).sum(1), 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    best = softmax(logits / temperature)
    right, sure = best.argmax(1) == truth.argmax(1), best.max(1)
    # the least confidence from which on the calibration rows are right 99 times in 100
    order = np.argsort(-sure)
    good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
    return LanguageModel(languages, table, bias, temperature, float(sure[order][good[-1]]) if len(good) else 1.0)


def training_rows(docs: DataFrame, most: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> list[tuple[list[int], list[int], str]]:
    """Subword counts of the first ``most`` usable documents by a hash of their id, and of the first ``least`` of each language; a row per id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches):
            counts = [subword_counts(t) for t in texts]
            at = [np.flatnonzero(c) for c in counts]
            kinds = pa.list_(pa.int32())
            cols = [pa.array([a.astype(np.int32) for a in at], kinds), pa.array([c[a].astype(np.int32) for c, a in zip(counts, at, strict=True)], kinds)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("lang")], ["at", "n", "lang"])

    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # the first by a hash of the id of all rows, and of each language; then one row per id
    first = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rare = usable.select("lang", "doc_id").distinct().withColumn("place", place).where(F.col("place") <= least).select("doc_id")
    chosen = stage(first.unionByName(rare).distinct(), "langid-chosen")
    texts = usable.join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids and ``least`` of each language
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "text", "lang")).alias("t")).select("t.text", "t.lang")
    rows = texts.mapInArrow(counted, "at array<int>, n array<int>, lang string").collect()
    return sorted(((r["at"], r["n"], r["lang"]) for r in rows if r["at"]), key=lambda r: (r[2], r[0], r[1]))


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row of ``docs`` (doc_id, text, lang).

    Learns from rows outside the held-out quarter with a language; other columns are not read.

    * null text or no letter: ``und``, score 0, not accepted; very short texts are scored as they are
    * null doc_id: held out; null lang: not learnt from; repeated rows: a result each
    * nothing to learn from: every row is ``und`` with score 0
    * ties go to the language that comes first; accepted is false below the rejection threshold
    """
    rows = training_rows(docs)
    model = fit(rows) if rows else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grouped(batches):
            known = np.array([model is not None and has_letter(t) for t in texts], bool)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for i in np.flatnonzero(known):
                p = model.probabilities(subword_counts(texts[i]))
                names[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
            accepted = known & (scores >= (model.reject_below if model else 1.0))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(predict, schema)
