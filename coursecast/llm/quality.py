"""Quality classifier by co-training: one view of the text, one of the page's metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.rules import rule_statistics
from coursecast.llm.shared import by_hash, giving_back, share
from coursecast.llm.textops import Chunk, chunks, sums

SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
TEXT_FEATURES = 18
META_FEATURES = 3 + SOURCE_BUCKETS + LANG_BUCKETS

_CLASSES = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b"\n", b"|"]
_MARKS = np.zeros((len(_CLASSES), 256), bool)
for _row, _bytes in zip(_MARKS, _CLASSES):
    _row[list(_bytes)] = True


def text_view(chunk: Chunk) -> np.ndarray:
    """What the text alone tells, one row per text: lengths, kinds of characters, repetition."""
    stats = rule_statistics(chunk)
    n = stats["n_words"].astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(chunk.text_at), 1)
    kinds = np.stack([chunk.count_bytes(m) / size for m in _MARKS], axis=1)
    words, owner = chunk.hashes(chunk.start, chunk.end), chunk.owner()
    twice = np.zeros(len(words), bool)
    twice[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.unique(words ^ (owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1]
    distinct = np.bincount(owner[pairs], minlength=len(chunk))
    long = sums((chunk.end - chunk.start > 20).astype(np.int64), chunk.word_at)
    rest = [
        np.log1p(n), n < 10, stats["word_chars"] / some, stats["n_symbols"] / some, stats["n_dup_lines"] / some,
        stats["n_repeat_words"] / some, sums(twice, chunk.word_at) / some, distinct / some, long / some,
    ]
    return np.concatenate([kinds, np.stack([np.asarray(r, float) for r in rest], axis=1)], axis=1)


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """What the row tells beside its text; null has a bucket of its own."""
    out = np.zeros((len(source), META_FEATURES))
    length = np.array([-1 if c is None else max(int(c), 0) for c in n_chars], float)
    out[:, 0] = length < 0
    out[:, 1] = np.log1p(np.maximum(length, 0))
    out[:, 2] = (length >= 0) & (length < 100)
    rows = np.arange(len(source))
    for values, first, n in ((source, 3, SOURCE_BUCKETS), (lang, 3 + SOURCE_BUCKETS, LANG_BUCKETS)):
        known = {v: 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (n - 1) for v in set(values)}
        out[rows, [first + known[v] for v in values]] = 1
    return out


@dataclass
class Logistic:
    """Standardised inputs, L2 penalty, fitted by Newton steps; then a calibration of its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stretch: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return (z @ self.weights[1:] + self.weights[0]) * self.stretch + self.shift


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = np.abs(change).max()
        w -= change * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    return Logistic(mean, scale, _newton(np.clip((x - mean) / scale, -6, 6), y, penalty))


@dataclass
class CoTrained:
    views: tuple[Logistic, ...]
    combine: np.ndarray
    threshold: float
    pseudo: tuple[int, ...] = ()  # pseudo-labels that each view has received

    def score(self, *views: np.ndarray) -> np.ndarray:
        logits = [np.clip(m.logit(v), -12, 12) for m, v in zip(self.views, views)]
        z = self.combine[0] + sum(w * z for w, z in zip(self.combine[1:], logits))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], *,
             rounds: int = 4, share: float = 0.1, sure: float = 0.9, keep: float = 0.99, seed: int = 3) -> CoTrained:
    """Two views of labelled and pool rows.

    A quarter of the labelled rows is set aside. Each round both views are fitted; each hands the other the
    pool rows it is surest of (odds beyond ``sure``, at most ``share`` of the pool, in the classes' ratio).
    On the rows set aside each view's log odds are calibrated, the two are combined, and the threshold is
    the best one by balanced accuracy that keeps ``keep`` of the good rows.
    """
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):  # of both classes
        rows = rng.permutation(np.flatnonzero(y == label))
        aside[rows[: len(rows) // 4]] = True
    if len(np.unique(y[aside])) < 2:
        aside[:] = False
    check = aside if aside.any() else np.ones(len(y), bool)
    xs = [v[~aside] for v in labelled]
    ys = [y[~aside].astype(float) for _ in labelled]
    free = np.ones(len(pool[0]), bool)
    good = float(y.mean())
    received = [0, 0]
    models = [_logistic(x, t) for x, t in zip(xs, ys)]
    for _ in range(rounds):
        gifts: list[tuple[np.ndarray, np.ndarray]] = []
        for model, view in zip(models, pool):
            p = 1 / (1 + np.exp(-np.clip(model.logit(view), -30, 30)))
            most = share * len(view)
            up = [r for r in np.argsort(-p, kind="stable")[: int(most * good)] if free[r] and p[r] >= sure]
            down = [r for r in np.argsort(p, kind="stable")[: int(most * (1 - good))] if free[r] and p[r] <= 1 - sure]
            gifts.append((np.array(up + down, int), np.array([1.0] * len(up) + [0.0] * len(down))))
        for view in (0, 1):
            rows, label = gifts[1 - view]
            xs[view] = np.concatenate([xs[view], pool[view][rows]])
            ys[view] = np.concatenate([ys[view], label])
            received[view] += len(rows)
        for rows, _ in gifts:
            free[rows] = False
        models = [_logistic(x, t) for x, t in zip(xs, ys)]
    for model, view in zip(models, labelled):
        shift, stretch = _newton(np.clip(model.logit(view[check])[:, None], -12, 12), y[check].astype(float), 0.1)
        model.stretch, model.shift = max(float(stretch), 0.0), float(shift)
    logits = np.stack([np.clip(m.logit(v[check]), -12, 12) for m, v in zip(models, labelled)], axis=1)
    weights = _newton(logits, y[check].astype(float), 0.1)
    weights[1:] = np.maximum(weights[1:], 0)
    out = CoTrained(tuple(models), weights, 0.0, tuple(received))
    scores = out.score(*(v[check] for v in labelled))
    is_good = y[check] == 1
    most = np.quantile(scores[is_good], 1 - keep, method="lower")
    cuts = np.unique(scores[scores <= most])
    right = np.array([np.mean(scores[is_good] >= c) + np.mean(scores[~is_good] < c) for c in cuts])
    best = int(np.flatnonzero(right >= right.max() - 1e-12)[0])
    below = scores[scores < cuts[best]]
    out.threshold = float((cuts[best] + (below.max() if len(below) else 0.0)) / 2)
    return out


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [text_view(c) for c in chunks(batch.column(1))]
    text = np.concatenate(parts) if parts else np.zeros((0, TEXT_FEATURES))
    return text, metadata_view(*(batch.column(k).to_pylist() for k in (2, 3, 4)))


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 8000, max_pool: int = 16000, **training) -> CoTrained | None:
    """Co-train on at most ``max_labelled`` labelled rows and ``max_pool`` others, both chosen by hash.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad; other values are no label). None if there are
    not two rows of each class.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("quality"))
    some = by_hash(known, ["doc_id"], max_labelled)
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").join(known, "doc_id", "left_anti")
    others = by_hash(others.distinct(), ["doc_id"], max_pool).withColumn("quality", F.lit(-1))
    chosen = some.unionByName(others)  # bounded by the two limits
    rows = _columns(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "source", "lang", "n_chars", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_views(batch), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "quality", "x"]
            )

    seen = rows.mapInArrow(giving_back(run), "doc_id long, quality int, x binary")
    once = seen.groupBy("doc_id").agg(F.min("quality"), F.min("x"))  # one text of a repeated id
    found = sorted(tuple(r) for r in once.collect())
    y = np.array([r[1] for r in found])
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return None
    x = np.stack([np.frombuffer(r[2], np.float32) for r in found]).astype(float)
    views = x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]
    return co_train(tuple(v[y >= 0] for v in views), y[y >= 0], tuple(v[y < 0] for v in views), **training)


def quality(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """``doc_id``, ``score`` (near 1: good) and ``kept`` of every row of documents.

    Null and empty texts and null metadata have features of their own; repeated rows are scored each; other
    columns are ignored. Without two labelled rows of each class every score is 0.5 and all rows are kept. An
    empty table gives an empty result.
    """
    shared = share(docs.sparkSession, fit(docs, labels, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            if model is None:
                score, kept = np.full(batch.num_rows, 0.5), np.ones(batch.num_rows, bool)
            else:
                score = model.score(*_views(batch))
                kept = score >= model.threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(kept)], ["doc_id", "score", "kept"])

    return _columns(docs).mapInArrow(giving_back(run), "doc_id long, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs`` (further ones stay as they are).

    Null and empty texts, null metadata, repeated rows, too few labels and an empty table are as for ``quality``.
    """
    shared = share(docs.sparkSession, fit(docs, labels, **fitting))
    names = ("doc_id", "text", "source", "lang", "n_chars")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            if model is not None:
                used = pa.RecordBatch.from_arrays([batch.column(n) for n in names], list(names))
                batch = batch.filter(pa.array(model.score(*_views(used)) >= model.threshold))
            yield batch

    return docs.mapInArrow(giving_back(run), schema)
