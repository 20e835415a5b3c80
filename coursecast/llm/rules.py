"""Quality rules with an isolation forest over the rule statistics of each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.shared import by_hash, giving_back, share
from coursecast.llm.textops import Chunk, chunks, covered, sums, whole_windows, windows

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EULER = 0.5772156649015329


def rule_statistics(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk, by name."""
    n_texts, n_words = len(chunk), len(chunk.start)
    prefix = chunk.prefix()
    first_byte = np.ones(256, bool)  # of a code point in a word
    first_byte[0x80:0xC0] = False
    first_byte[[9, 10, 11, 12, 13, 32]] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True

    # Lines: from a text's start or the byte after a line feed, up to the next line feed or the end.
    feeds = np.flatnonzero(chunk.buf == 10)
    begin = np.sort(np.concatenate([chunk.text_at[:-1], feeds + 1]))
    owner = np.searchsorted(chunk.text_at, np.concatenate([chunk.text_at[:-1], feeds]), "right") - 1
    owner[:n_texts] = np.arange(n_texts)
    owner = np.sort(owner)
    finish = np.sort(np.concatenate([chunk.text_at[1:], feeds]))
    with_word = np.searchsorted(chunk.start, finish) > np.searchsorted(chunk.start, begin)
    owner, begin, finish = owner[with_word], begin[with_word], finish[with_word]
    lines = chunk.hashes(begin, finish, prefix)
    order = np.lexsort((lines, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    n_dup_lines = np.bincount(owner[order][again], minlength=n_texts)

    words = chunk.hashes(chunk.start, chunk.end, prefix)
    grams = windows(words, WINDOW)
    at = np.flatnonzero(whole_windows(chunk.word_at, WINDOW, n_words))
    text_of = chunk.owner()
    keyed = grams[at] ^ (text_of[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    repeated = np.zeros(len(order), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    in_repeat = covered(at[order[repeated]], WINDOW, n_words)
    return {
        "n_words": chunk.n_words(),
        "word_chars": chunk.count_bytes(first_byte),
        "n_symbols": chunk.count_bytes(symbol),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": sums(in_repeat, chunk.word_at),
    }


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: rates per word, so that length alone is no anomaly."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = np.asarray(stats, float).T
    some = np.maximum(n_words, 1)
    return np.stack(
        [np.minimum(np.log1p(n_words), 4.0), np.minimum(word_chars / some, 20.0), n_symbols / some,
         n_dup_lines / some, n_repeat_words / some], axis=1,
    )


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points, which need not be whole."""
    n = np.maximum(np.asarray(n, float), 1.0)
    harmonic = np.log(n - 0.5) + _EULER + 1 / (24 * (n - 0.5) ** 2)  # of n - 1, to 0.2 percent from 2 points on
    return np.where(n >= 2, 2 * harmonic - 2 * (n - 1) / n, n - 1)


@dataclass
class IsolationForest:
    """Trees in arrays of one row per tree: heap-numbered nodes with a column, a cut and a size."""

    column: np.ndarray
    cut: np.ndarray
    length: np.ndarray  # path length at a leaf
    norm: float
    threshold: float = 1.0

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        rows = np.arange(len(x))
        for column, cut in zip(self.column, self.cut):
            node = np.zeros(len(x), np.int64)
            while True:
                inner = column[node] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(column[node], 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            yield node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1 of each row, to five digits; about 0.5 is ordinary, nearer 1 is isolated early."""
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for node, length in zip(self.leaves(x), self.length):
            total += length[node]
        return np.round(2.0 ** (-total / len(self.column) / max(self.norm, 1e-9)), 5)


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> IsolationForest:
    """Random splits of random subsamples, to the depth an average point needs. Each tree has rows of its own if ``x`` has enough."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 2 ** (depth + 1) - 1
    column = np.full((trees, size), -1)
    cut = np.zeros((trees, size))
    length = np.zeros((trees, size))
    dealt = rng.permutation(len(x))
    for t in range(trees):
        own = dealt[t * sample : (t + 1) * sample]
        todo = [(0, 0, own if len(own) == sample else rng.choice(len(x), sample, replace=False))]
        while todo:
            node, level, rows = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if level == depth or len(rows) <= 1 or not len(usable):
                length[t, node] = level  # what is left to go comes from the counts of all rows
                continue
            c = rng.choice(usable)
            column[t, node], cut[t, node] = c, rng.uniform(low[c], high[c])
            if cut[t, node] <= low[c]:
                cut[t, node] = high[c]
            right = x[rows, c] >= cut[t, node]
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return IsolationForest(column, cut, length, float(mean_path(np.array(sample))))


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The threshold with the best balanced accuracy among those that keep ``keep`` of the good rows.

    ``scores`` ascend; ``good`` and ``bad`` count the rows of each. With no good or no bad row, nothing is above the threshold.
    """
    if not good.sum() or not bad.sum():
        return 1.0
    kept, passed = np.cumsum(good), np.cumsum(bad)
    place = int(np.ceil(round(keep * (kept[-1] - 1), 6)))
    least = int(np.searchsorted(kept, place, "right"))
    right = (kept / kept[-1] - passed / passed[-1])[least:]
    best = least + np.flatnonzero(right >= right.max() - 1e-12)[-1]
    upper = scores[best + 1] if best + 1 < len(scores) else 1.0
    return float((scores[best] + upper) / 2)


def base_rules(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the five rule statistics of every row; a null text has no words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [rule_statistics(c) for c in chunks(batch.column(1))]
            columns = [np.concatenate([p[s] for p in parts]) if parts else [] for s in STATISTICS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *STATISTICS]
            )

    return docs.mapInArrow(giving_back(run), "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


def _rates(batch: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1))


def weighed(forest: IsolationForest, rows: DataFrame, sample: int) -> IsolationForest:
    """The forest with path lengths by the share of all ``rows`` that is in each leaf."""
    shared, size = share(rows.sparkSession, forest), forest.column.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = shared(), np.zeros(shared().column.size, np.int64)
        for batch in batches:
            for t, node in enumerate(forest.leaves(_rates(batch))):
                n[t * size : (t + 1) * size] += np.bincount(node, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["leaf", "n"])

    counts = rows.select(*STATISTICS).mapInArrow(giving_back(run), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    share_of = np.zeros(forest.column.size)
    share_of[counts["leaf"].to_numpy()] = counts["n"].to_numpy() / (counts["n"].sum() / len(forest.column))
    forest.length += mean_path(sample * share_of.reshape(forest.column.shape))
    return forest


def fit(stats: DataFrame, labels: DataFrame, *, trees: int = 200, sample: int = 16, keep: float = 0.995, seed: int = 7) -> IsolationForest:
    """A forest of all rows, its threshold from all labelled ones.

    The cuts of a tree are random, between values of ``sample`` rows that hash order draws from all; path lengths come
    from the numbers of all rows in each leaf. Subsamples are small because junk of one kind is frequent: in a larger one
    it would form a cluster that no longer looks isolated.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad; null is no label). Rows that the base rules
    fail take part in neither: the forest judges what is left. The driver gets the rows that cuts come from, a number per leaf and
    a pair of numbers per different score.
    """
    left = stats.filter(~base_rules(F.col("n_words"), F.col("n_repeat_words")))
    rows = by_hash(left, ["doc_id", *STATISTICS], trees * sample).select(*STATISTICS).toPandas()
    if not len(rows):
        return IsolationForest(np.full((1, 1), -1), np.zeros((1, 1)), np.ones((1, 1)), 1.0)
    forest = grow(features(rows.to_numpy()), trees, sample, seed)
    forest = weighed(forest, left, min(sample, len(rows)))
    named = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shared = share(stats.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int64()), pa.array(shared().score(_rates(batch)))], ["quality", "score"])

    known = left.join(named, "doc_id").select("quality", *STATISTICS).mapInArrow(giving_back(run), "quality long, score double")
    known = known.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toPandas().sort_values("score")
    forest.threshold = calibrate(*(known[c].to_numpy() for c in ("score", "good", "bad")), keep) if len(known) else 1.0
    return forest


def judge(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Statistics with ``base_failed``, ``anomaly`` and ``kept``."""
    shared = share(stats.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared()
        for batch in batches:
            values = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1)
            failed = base_rules(values[:, 0], values[:, 4])
            anomaly = forest.score(features(values))
            kept = ~failed & (anomaly <= forest.threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(kept)],
                [*batch.schema.names, "base_failed", "anomaly", "kept"],
            )

    kinds = ", ".join(f"{s} long" for s in STATISTICS)
    return stats.mapInArrow(giving_back(run), f"doc_id long, {kinds}, base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **fitting) -> DataFrame:
    """One row per document: rule statistics, whether a base rule fails it, anomaly, verdict.

    Null or empty text: all counts 0, fails the base rules. Repeated rows each get their row, a null id
    keeps its row, other columns are ignored. Without labels of both kinds the forest rejects nothing; an
    empty table gives an empty result. The statistics are written once to the shared scratch folder.
    """
    from coursecast.sources.scratch import settle

    stats = settle(statistics(docs, text_col=text_col), "rules")
    return judge(stats, fit(stats, labels, **fitting))
