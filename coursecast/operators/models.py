"""Ridge regression and random forest with cross-validated settings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursecast.functions.courses import bucket
from coursecast.functions.names import key_columns
from coursecast.operators.accuracy import course_accuracy, regression_metrics
from coursecast.operators.features import fit_preprocessing, in_training, row_key, select_features
from coursecast.operators.forest import Trees, cut_back, squared_errors
from coursecast.schema import TARGET
from coursecast.sources.scratch import settle

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)  # fixed values: ridge penalties tried
# Candidate split points per feature, at least. The default of 32 would lump course numbers together; more known
# labels than this get a split point each.
LEAST_BINS = 1024
MAX_DEPTH = 30  # deepest tree Spark builds; stands in for "no limit"

# The whole forest grid of 108 points, searched unless the caller names another, and a small one. No limit of the
# depth and 30 are one and the same here, so 81 points differ. ``minSplit`` is the fewest rows that a node needs to be split.
FULL_FOREST = {
    "numTrees": (100, 200, 300), "maxDepth": (MAX_DEPTH, 10, 20, 30), "minSplit": (2, 5, 10), "minInstancesPerNode": (1, 2, 4),
}
SMALL_FOREST = {"numTrees": (100,), "maxDepth": (MAX_DEPTH, 10), "minSplit": (2,), "minInstancesPerNode": (1, 4)}


@dataclass
class Fitted:
    """A trained model with its preprocessing, and what is known about the training."""

    model: PipelineModel
    info: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.info["features"]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def _fit_ridge(encoded: DataFrame, alpha: float) -> Model:
    """Least squares with penalty ``alpha * |w|^2``.

    Spark scales its loss by the row count and the label deviation, so the same penalty is
    ``regParam = alpha * stddev_pop(label) / n``.
    """
    row = encoded.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    return LinearRegression(
        featuresCol="features",
        labelCol="label",
        elasticNetParam=0.0,
        regParam=alpha * (row["sd"] or 0.0) / max(row["n"], 1),
        standardization=False,
        solver="normal",
    ).fit(encoded)


def moments(encoded: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Per fold, in order, the sums of all products of a one, the columns and the label, in one job.

    Each task multiplies its rows as one matrix and hands on the upper triangle; the sums over the tasks are
    Spark's. So hundreds of columns are one product a batch, not an expression for each pair.
    """
    values = [*columns, "label"]
    size = len(values) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(k).to_numpy() for k in range(1, size))])
            for f in np.unique(fold).tolist():
                mine = x[fold == f]
                own[f] = own.get(f, 0.0) + mine.T @ mine
        i, j = np.triu_indices(size)
        for f, m in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["fold", "i", "j", "v"])

    rows = encoded.select(F.col("fold").cast("long").alias("fold"), *[F.col(c).cast("double").alias(c) for c in values])
    sums = rows.mapInArrow(run, "fold long, i long, j long, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for _, part in sorted(sums.groupby("fold")):
        m = np.zeros((size, size))
        m[part.i, part.j] = m[part.j, part.i] = part.v
        out.append(m)
    return out


def ridge_errors(encoded: DataFrame, columns: Sequence[str], alphas: Sequence[float]) -> list[float]:
    """Mean squared error of each penalty, averaged over the held-out folds.

    One pass over the data serves the whole search: a fold's training and held-out errors for any penalty follow
    from the sums of products within each fold. Only one matrix per fold reaches the driver.
    """
    moments_ = moments(encoded, columns)
    total = sum(moments_)

    def held_out_error(test: np.ndarray, alpha: float) -> float:
        fit_on = total - test
        penalty = np.diag([0.0] + [alpha] * len(columns))  # the intercept is not penalized
        w = np.linalg.solve(fit_on[:-1, :-1] + penalty, fit_on[:-1, -1])
        residual = np.append(-w, 1.0)
        return residual @ test @ residual / test[0, 0]

    return [float(np.mean([held_out_error(m, a) for m in moments_])) for a in alphas]


def _search_ridge(encoded, columns, grid, folds, parallelism, labels):
    alphas = list((grid or {"alpha": ALPHAS})["alpha"])
    errors = ridge_errors(encoded, columns, alphas) if len(alphas) > 1 else []
    best = alphas[int(np.argmin(errors))] if errors else alphas[0]
    return _fit_ridge(encoded, best), [{"alpha": a} for a in alphas], errors


def _search_forest(encoded, columns, grid, folds, parallelism, labels):
    """Mean squared error of all grid points over the folds.

    For each combination of the settings that change how a tree grows, one forest per fold is grown to the greatest depth;
    all depths and minimum split sizes are read off by cutting it back. The best point's forest is grown
    on all rows.
    """
    spark = encoded.sparkSession
    grid = {name: tuple(dict.fromkeys(values)) for name, values in (grid or FULL_FOREST).items()}
    depths, splits = grid.pop("maxDepth", (5,)), grid.pop("minSplit", (2,))
    cuts = list(product(depths, splits))
    grown = [dict(zip(grid, values)) for values in product(*grid.values())]
    settings = [{**g, "maxDepth": d, "minSplit": s} for g in grown for d, s in cuts]

    def forest(depth: int, setting: Mapping) -> RandomForestRegressor:
        return RandomForestRegressor(
            featuresCol="features", labelCol="label", featureSubsetStrategy="all", maxBins=max(LEAST_BINS, labels + 1), seed=42,
            maxDepth=depth, **setting,
        )

    def errors_of(unit: tuple[Mapping, int]) -> np.ndarray:
        setting, fold = unit
        model = forest(max(depths), setting).fit(encoded.filter(F.col("fold") != fold))
        return squared_errors(encoded.filter(F.col("fold") == fold), Trees.of(spark, model), cuts)

    errors = []
    if len(settings) > 1:
        units = list(product(grown, range(folds)))
        with ThreadPoolExecutor(parallelism) as pool:
            found = np.array(list(pool.map(errors_of, units))).reshape(len(grown), folds, len(cuts))
        errors = np.nanmean(found, axis=1).ravel().tolist()
    best = settings[int(np.argmin(errors))] if errors else settings[0]
    rest = {k: v for k, v in best.items() if k not in ("maxDepth", "minSplit")}
    model = forest(best["maxDepth"], rest).fit(encoded)
    return cut_back(spark, model, best["minSplit"]), settings, errors


# Search function and number of folds of each kind of model.
KINDS = {"linear": (_search_ridge, 5), "tree": (_search_forest, 3)}


def fit(
    data: DataFrame,
    kind: str = "tree",
    schema: str = "min",
    grid: Mapping[str, Sequence] | None = None,
    unseen: str = "first",
    fold_by: Sequence[str] | None = None,
    folds: int | None = None,
    parallelism: int = 4,
) -> Fitted:
    """Train on the training part of a feature table and pick the grid point by squared error.

    Key columns are found by role, whatever their names. ``fold_by=("subj", "crse")`` keeps a course within one fold. The training rows are written
    once, since encoding, scaling and the search each read them: the sections behind them are
    scanned a single time, also when executors are lost on the way.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown model kind: {kind}")
    search, default_folds = KINDS[kind]
    folds = folds or default_folds
    features = select_features(data, schema)
    key = row_key(data)
    train = settle(data.filter(in_training(key=key)), "training")
    preprocessing = fit_preprocessing(train, features, unseen)
    scaled = [f"{c}_scaled" for c in features]
    encoded = preprocessing.transform(train).select(
        "features",
        *scaled,
        F.col(TARGET).cast("double").alias("label"),
        bucket([F.col(c) for c in fold_by or key], folds, seed="fold").alias("fold"),
    )
    labels = max((len(x) for s in preprocessing.stages if isinstance(s, StringIndexerModel) for x in s.labelsArray), default=0)
    model, settings, errors = search(encoded, scaled, grid, folds, parallelism, labels)
    best = int(np.argmin(errors)) if errors else 0
    info = {
        "kind": kind,
        "schema": schema,
        "features": features,
        "key": key,
        "unseen": unseen,
        "best_params": settings[best],
        "cv_mse": [{**s, "mse": float(e)} for s, e in zip(settings, errors)],
    }
    return Fitted(PipelineModel([*preprocessing.stages, model]), info)


def predict(data: DataFrame, fitted: Fitted) -> DataFrame:
    """Feature rows with their prediction. Missing feature columns are an error."""
    missing = [c for c in fitted.features if c not in data.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return fitted.transform(data).select(*data.columns, "prediction")


def fit_report(data: DataFrame, fitted: Fitted) -> DataFrame:
    """Metrics of the training and validation parts, one row each."""
    part = F.when(in_training(key=row_key(data)), "train").otherwise("validation")
    scored = predict(data, fitted).select(
        part.alias("part"), F.col(TARGET).alias("actual"), "prediction"
    )
    return regression_metrics(scored, by=["part"])


def search_report(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(params, mse): mean cross-validation error of each grid point."""
    rows = [
        (", ".join(f"{k}={v}" for k, v in sorted(p.items()) if k != "mse"), float(p["mse"]))
        for p in fitted.info["cv_mse"]
    ]
    return spark.createDataFrame(rows, "params string, mse double")


def validation_accuracy(data: DataFrame, fitted: Fitted) -> DataFrame:
    """Accuracy per course on the validation part."""
    scored = predict(data.filter(~in_training(key=row_key(data))), fitted)
    roles = key_columns(data.columns)
    scored = scored.withColumnsRenamed({roles[r]: r for r in ("subj", "crse")})
    return course_accuracy(scored, actual=TARGET)


def feature_importance(spark: SparkSession, fitted: Fitted, top: int | None = None) -> DataFrame:
    """(feature, importance) of a forest, strongest first; ``top`` rows if given."""
    weights = fitted.model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(
        list(zip(fitted.features, weights)), "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)


def coefficients(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(feature, weight) of a ridge model on scaled features, with its intercept."""
    last = fitted.model.stages[-1]
    rows = [*zip(fitted.features, last.coefficients.toArray().tolist()), ("intercept", float(last.intercept))]
    return spark.createDataFrame(rows, "feature string, weight double")


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """``path/model`` holds the stages and ``path/info`` one JSON row."""
    fitted.model.write().overwrite().save(f"{path}/model")
    row = spark.createDataFrame([(json.dumps(fitted.info),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> Fitted:
    info = json.loads(spark.read.text(f"{path}/info").first()["value"])
    return Fitted(PipelineModel.load(f"{path}/model"), info)
