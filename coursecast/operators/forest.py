"""Forests grown once and cut back: every depth and minimum split size from the nodes of the deepest forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.sources.scratch import scratch_path, settle


def node_table(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """One row per node of a forest, as Spark stores it: tree, node, children, split, prediction and rows below it."""
    path = scratch_path(spark, "forest")
    model.save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.rawCount").alias("rows"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.numCategories").alias("categories"),
        F.element_at(F.when(F.size("nodeData.split.leftCategoriesOrThreshold") > 0, F.col("nodeData.split.leftCategoriesOrThreshold")), 1).alias("threshold"),
    )


@dataclass
class Trees:
    """The nodes of all trees in arrays; ``root`` has where each tree begins."""

    root: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    prediction: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, model: RandomForestRegressionModel) -> Trees:
        """The driver holds a forest anyway: it has grown it."""
        table = node_table(spark, model).toPandas().sort_values(["tree", "node"])
        if (table.categories[table.left >= 0] >= 0).any():
            raise ValueError("only splits of numbers can be cut back")
        tree = table.tree.to_numpy()
        root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        first = np.repeat(root, np.diff(np.append(root, len(tree))))  # nodes are numbered from 0 within a tree
        child = [np.where(table[c] >= 0, table[c] + first, -1) for c in ("left", "right")]
        return cls(root, *child, table.feature.to_numpy(), table.threshold.fillna(0.0).to_numpy(), table.prediction.to_numpy(), table.rows.to_numpy())

    def predict(self, x: np.ndarray, cuts: Sequence[tuple[int, int]]) -> np.ndarray:
        """Predictions of ``x`` (rows by features) by the forest cut back to each (depth, least rows of a split), a row each.

        A cut-back tree is the grown one whose nodes beyond the depth, or with fewer rows than a split needs, are
        leaves. So one walk down serves all: each cut takes the prediction of the node at which it stops.
        """
        out = np.zeros((len(cuts), len(x)))
        rows = np.arange(len(x))
        for root in self.root:
            node, depth = np.full(len(x), root), 0
            waiting = np.ones((len(cuts), len(x)), bool)
            while waiting.any():
                leaf = self.left[node] < 0
                for k, (most, least) in enumerate(cuts):
                    stops = waiting[k] & (leaf | (self.rows[node] < least) | (depth >= most))
                    out[k, stops] += self.prediction[node[stops]]
                    waiting[k] &= ~stops
                go = ~leaf
                goes_left = x[rows[go], self.feature[node[go]]] <= self.threshold[node[go]]
                node[go] = np.where(goes_left, self.left[node[go]], self.right[node[go]])
                depth += 1
        return out / len(self.root)


def squared_errors(held_out: DataFrame, trees: Trees, cuts: Sequence[tuple[int, int]]) -> np.ndarray:
    """Mean squared error of each cut over rows with ``features`` and ``label``, in one pass over them."""
    shared = held_out.sparkSession.sparkContext.broadcast(tuple(vars(trees).values()))
    most = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Trees(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            errors = ((grown.predict(x, cuts) - batch.column(1).to_numpy()) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(most)), pa.array(errors), pa.array(np.full(most, batch.num_rows))], ["cut", "error", "n"]
            )

    rows = held_out.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    found = rows.mapInArrow(run, "cut long, error double, n long").groupBy("cut").agg((F.sum("error") / F.sum("n")).alias("mse"))
    by_cut = {r.cut: r.mse for r in found.collect()}
    return np.array([by_cut.get(k, np.nan) for k in range(most)])


def cut_back(spark: SparkSession, model: RandomForestRegressionModel, least: int) -> RandomForestRegressionModel:
    """The model with every node of fewer than ``least`` rows a leaf."""
    if least <= 2:
        return model
    path, cut = scratch_path(spark, "forest"), scratch_path(spark, "forest-cut")
    model.save(path)
    stored = spark.read.parquet(f"{path}/data")
    schema = stored.schema

    def prune(key: tuple, table: pa.Table) -> pa.Table:
        """One tree: what hangs below a cut node goes, the others are numbered anew in their order."""
        rows = sorted(table.to_pylist(), key=lambda r: r["nodeData"]["id"])
        by_id = {r["nodeData"]["id"]: r["nodeData"] for r in rows}
        kept, todo = [], [rows[0]["nodeData"]["id"]]
        while todo:
            node = by_id[todo.pop()]
            if node["rawCount"] < least:
                node["leftChild"] = node["rightChild"] = -1
            kept.append(node["id"])
            todo += [c for c in (node["rightChild"], node["leftChild"]) if c >= 0]
        new = {old: k for k, old in enumerate(sorted(kept))}
        nothing = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        for old, k in new.items():
            node = by_id[old]
            node["id"] = k
            for side in ("leftChild", "rightChild"):
                node[side] = new.get(node[side], -1)
            if node["leftChild"] < 0:
                node["split"], node["gain"] = nothing, -1.0
        stays = [r for r, old in zip(rows, by_id) if old in new]
        return pa.Table.from_pylist(stays, table.schema)

    pruned = settle(stored.groupBy("treeID").applyInArrow(prune, schema), "forest-pruned")
    model.write().overwrite().save(cut)
    pruned.repartition(1).write.mode("overwrite").parquet(f"{cut}/data")
    return RandomForestRegressionModel.load(cut)
