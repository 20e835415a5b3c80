"""The isolation forest of the quality rules: path lengths from all rows, threshold from all labelled rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from coursecast.llm.rules import STATISTICS, calibrate, features, fit, mean_path

N, TREES, SAMPLE = 12_000, 12, 16


def test_all_rows_take_part(spark):
    rng = np.random.default_rng(3)
    n_words = rng.integers(10, 400, N)
    stats = pd.DataFrame({
        "doc_id": np.arange(N), "n_words": n_words, "word_chars": n_words * rng.integers(3, 9, N),
        "n_symbols": rng.integers(0, 9, N) ** 2, "n_dup_lines": rng.integers(0, 3, N), "n_repeat_words": rng.integers(0, 2, N),
    })
    quality = np.where(stats["n_symbols"] > 20 + 30 * rng.random(N), 0, 1)
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(N), "quality": quality}))
    forest = fit(spark.createDataFrame(stats).repartition(4), labels, trees=TREES, sample=SAMPLE, keep=0.9)
    x = features(stats[list(STATISTICS)].to_numpy())

    for t, leaf in enumerate(forest.leaves(x)):
        n = np.bincount(leaf, minlength=forest.column.shape[1])
        reached = np.flatnonzero(n)
        level = np.floor(np.log2(reached + 1))
        np.testing.assert_allclose(forest.length[t, reached], level + mean_path(SAMPLE * n[reached] / N))

    scores, place = np.unique(forest.score(x), return_inverse=True)
    good, bad = np.bincount(place, quality), np.bincount(place, 1 - quality)
    assert forest.threshold == calibrate(scores, good, bad, 0.9)


def test_one_kind_of_label_rejects_nothing():
    assert calibrate(np.array([0.2, 0.4]), np.array([3, 1]), np.array([0, 0]), 0.9) == 1.0
    assert calibrate(np.array([0.2, 0.4, 0.6]), np.array([9, 1, 0]), np.array([0, 0, 5]), 0.995) == 0.5
