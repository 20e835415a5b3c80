"""Forests cut back against forests grown that way, and what the searched forest reports against its nodes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from coursecast.operators import aggregates, forest, models
from coursecast.operators.features import in_training


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).selectExpr("cast(id % 17 as double) as a", "cast(id % 29 as double) as b", "cast((id * id * 37) % 101 + id % 17 * 3 as double) as label")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


def grow(rows, depth):
    return RandomForestRegressor(numTrees=4, maxDepth=depth, featureSubsetStrategy="all", seed=42, maxBins=64).fit(rows)


def test_cut_depths_are_grown_depths(spark, rows):
    x = np.array([r.features.toArray() for r in rows.select("features").collect()])
    trees = forest.Trees.of(spark, grow(rows, 12))
    got = trees.predict(x, [(12, 2), (6, 2), (3, 2), (0, 2)])
    for k, depth in enumerate((12, 6, 3, 0)):
        want = [r.prediction for r in grow(rows, depth).transform(rows).select("prediction").collect()]
        assert np.allclose(got[k], want, rtol=0, atol=1e-9)
    errors = forest.squared_errors(rows, trees, [(12, 2), (3, 2)])
    label = np.array([r.label for r in rows.select("label").collect()])
    assert np.allclose(errors, [((got[0] - label) ** 2).mean(), ((got[2] - label) ** 2).mean()])


def test_minimum_split_size(spark, rows):
    model = grow(rows, 12)
    table = forest.node_table(spark, model)
    assert table.filter("left >= 0 and rows < 25").count() > 0
    cut = forest.cut_back(spark, model, 25)
    after = forest.node_table(spark, cut)
    assert after.filter("left >= 0 and rows < 25").count() == 0
    assert after.groupBy("tree").agg((F.max("node") + 1 - F.count("*")).alias("d")).filter("d <> 0").count() == 0
    x = np.array([r.features.toArray() for r in rows.select("features").collect()])
    want = forest.Trees.of(spark, model).predict(x, [(30, 25)])[0]
    got = [r.prediction for r in cut.transform(rows).select("prediction").collect()]
    assert np.allclose(got, want, rtol=0, atol=1e-9) and cut.featureImportances.toArray().sum() == pytest.approx(1)
    assert forest.cut_back(spark, model, 2) is model


def test_search_over_split_sizes(spark, sections):
    data = aggregates.course_term(sections)
    fitted = models.fit(data, "tree", grid={"numTrees": (5,), "maxDepth": (3, 12), "minSplit": (2, 40)})
    points = {(p["maxDepth"], p["minSplit"]): p["mse"] for p in fitted.info["cv_mse"]}
    assert set(points) == {(3, 2), (3, 40), (12, 2), (12, 40)} and len(set(points.values())) >= 3
    best = fitted.info["best_params"]
    assert points[best["maxDepth"], best["minSplit"]] == min(points.values())
    table = forest.node_table(spark, fitted.model.stages[-1]).toPandas()
    assert (table[table.left >= 0].rows >= best["minSplit"]).all()

    used = {fitted.features[k] for k in table[table.left >= 0].feature.unique()}
    found = {r.feature: r.importance for r in models.feature_importance(spark, fitted).collect()}
    assert sum(found.values()) == pytest.approx(1) and {f for f, w in found.items() if w > 0} == used
    top = models.feature_importance(spark, fitted, top=2).collect()
    assert [r.feature for r in top] == sorted(found, key=lambda f: (-found[f], f))[:2]

    rows = data.filter(~in_training())
    again = models.predict(rows, models.fit(data, "tree", grid={"numTrees": (5,), "maxDepth": (best["maxDepth"],), "minSplit": (best["minSplit"],)}))
    key = ["term", "subj", "crse"]
    same = models.predict(rows, fitted).select(*key, F.col("prediction").alias("p")).join(again.select(*key, "prediction"), key)
    assert same.filter("abs(p - prediction) > 1e-9").count() == 0 and same.count() == rows.count()
