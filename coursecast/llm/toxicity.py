"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.shared import by_hash, giving_back, share
from coursecast.llm.textops import LOWER, SPACE, Chunk, chunks, mix

#: Bytes between words: white space and ASCII punctuation.
BETWEEN = SPACE.copy()
BETWEEN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

#: Word offsets of the features: words, pairs, triples, and pairs and triples with one word left out.
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 1, 3), (0, 2, 3))


def gram_buckets(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every n-gram and skip-gram of a chunk, with repeats."""
    words = chunk.hashes(chunk.start, chunk.end)
    owner = chunk.owner()
    texts, buckets = [], []
    for kind, offsets in enumerate(GRAMS):
        n = len(words) - offsets[-1]
        if n <= 0:
            continue
        h = np.full(n, np.uint64(kind + 1))
        for k in offsets:
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        one_text = owner[:n] == owner[offsets[-1] :]
        texts.append(owner[:n][one_text])
        buckets.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64)[one_text])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(buckets)


@dataclass
class Ftrl:
    """Per-coordinate learning rates, L1 and L2 shrinkage; features are present or absent."""

    bits: int
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << self.bits)
        self.n = np.zeros(1 << self.bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        w, b = self.weights(features), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        before = np.sqrt(self.n[features])
        self.n[features] += g * g
        self.z[features] += g - (np.sqrt(self.n[features]) - before) / self.alpha * w
        before = np.sqrt(self.bias_n)
        self.bias_n += g * g
        self.bias_z += g - (np.sqrt(self.bias_n) - before) / self.alpha * b


@dataclass
class Weights:
    """The coordinates that L1 has left: a few thousand of 2**bits, safe to broadcast."""

    bits: int
    at: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.value
        return out


def held_out(doc_id):
    """Rows kept apart from learning: crc32 of the id as text is a multiple of five; not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, bits: int = 20, epochs: int = 4,
        text_col: str = "text", seed: int = 11) -> Weights:
    """Learn from at most ``max_rows`` labelled documents that are not held out, chosen by hash.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; other values are no label). The features are made on
    the executors; the driver gets bucket numbers of the sample only. Without labels all scores are 0.5.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = by_hash(known, ["doc_id"], max_rows, seed)
    sample = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c in chunks(batch.column(1), fold=LOWER, space=BETWEEN):
                text, bucket = gram_buckets(c, bits)
                pairs = np.unique((text << bits) | bucket)
                cut = np.searchsorted(pairs, np.arange(1, len(c)) << bits)
                found += [p.astype(np.int32) for p in np.split(pairs & ((1 << bits) - 1), cut)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([p.tobytes() for p in found], pa.binary())],
                ["doc_id", "toxic", "features"],
            )

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(giving_back(run), "doc_id long, toxic int, features binary")
    rows = rows.groupBy("doc_id").agg(F.min("toxic"), F.min("features")).collect()  # one text of a repeated id
    rows = [(r[0], r[1], np.frombuffer(r[2], np.int32)) for r in rows]
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
    model = Ftrl(bits)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            model.learn(rows[k][2], rows[k][1])
    at = np.flatnonzero(np.abs(model.z) > model.l1)
    return Weights(bits, at, model.weights(at), float(model.bias()))


def score(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row, from its text alone."""
    shared = share(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        dense = model.dense()
        for batch in batches:
            sums = []
            for c in chunks(batch.column(1), fold=LOWER, space=BETWEEN):
                text, bucket = gram_buckets(c, model.bits)
                active = dense[bucket] != 0
                pairs = np.unique((text[active] << model.bits) | bucket[active])
                sums.append(np.bincount(
                    pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)].astype(float), len(c)
                ))
            total = np.concatenate(sums) if sums else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    A null or empty text gets the score of no feature. Repeated rows are scored each; a null id is not
    held out; other columns are ignored; an empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, **fitting))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
