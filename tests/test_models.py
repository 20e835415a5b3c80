from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursecast.operators import aggregates, features, models
from coursecast.plans import scoring, standin, training
from coursecast.schema import TARGET
from coursecast.sources.scratch import settle
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark, sf):
    return settle(standin.features(spark, sf), "test-features")


@pytest.fixture(scope="module")
def ridge(data):
    return models.fit(data, "linear")


def matrix(data):
    """Encoded, scaled training rows in plain numpy."""
    pdf = data.filter(features.in_training()).toPandas()
    columns = []
    for name in ("term", "subj", "crse", "credits"):
        values = pdf[name]
        if name in ("subj", "crse"):
            codes = {v: i for i, v in enumerate(sorted(values.astype(str).unique()))}
            values = values.astype(str).map(codes)
        values = values.to_numpy(float)
        columns.append((values - values.mean()) / values.std())
    return np.column_stack(columns), pdf[TARGET].to_numpy(float)


def closed_form(x, y, alpha):
    centered = x - x.mean(axis=0)
    w = np.linalg.solve(centered.T @ centered + alpha * np.eye(x.shape[1]), centered.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


@pytest.mark.parametrize("alpha", [0.1, 100.0])
def test_ridge_equals_closed_form(spark, data, alpha):
    fitted = models.fit(data, "linear", grid={"alpha": [alpha]})
    w, b = closed_form(*matrix(data), alpha)
    got = {r.feature: r.weight for r in models.coefficients(spark, fitted).collect()}
    assert [got[f] for f in fitted.features] == pytest.approx(list(w), rel=1e-9, abs=1e-9)
    assert got["intercept"] == pytest.approx(b, rel=1e-9)


def test_ridge_search_equals_fitting_each_fold(spark, data, ridge):
    x, y = matrix(data)
    pdf = data.filter(features.in_training()).withColumn(
        "fold", features.bucket([F.col(c) for c in features.KEY], 5, seed="fold")
    ).toPandas()
    fold = pdf["fold"].to_numpy()
    for point in ridge.info["cv_mse"]:
        errors = []
        for k in range(5):
            w, b = closed_form(x[fold != k], y[fold != k], point["alpha"])
            errors.append(np.mean((y[fold == k] - x[fold == k] @ w - b) ** 2))
        assert point["mse"] == pytest.approx(np.mean(errors), rel=1e-8)
    best = min(ridge.info["cv_mse"], key=lambda p: p["mse"])
    assert ridge.info["best_params"] == {"alpha": best["alpha"]}
    assert models.search_report(spark, ridge).count() == 5


def test_split_depends_on_the_key_only(data):
    a = rows(data.filter(features.in_training()).select("term", "subj", "crse"))
    b = rows(data.repartition(13).filter(features.in_training()).select("term", "subj", "crse"))
    assert a == b
    train, held_out = features.split(data)
    assert train.count() + held_out.count() == data.count()
    assert 0.7 < train.count() / data.count() < 0.9


def test_unseen_categories(data):
    known = data.filter("subj <> 'PROMO'")
    for policy, code in (("first", 0.0), ("minus_one", -1.0)):
        encoding = features.fit_encoding(known, ["subj"], unseen=policy)
        got = encoding.transform(data.filter("subj = 'PROMO'")).select("subj_code").distinct()
        assert rows(got) == [(code,)]
        assert encoding.transform(known).filter("subj_code < 0").count() == 0


def test_course_codes_do_not_depend_on_number_format(spark):
    whole = spark.createDataFrame([(300,), (1000,), (45,)], "crse int")
    fitted = features.fit_encoding(whole, ["crse"])
    text = spark.createDataFrame([("300.0",), ("1000",), (" 45 ",)], "crse string")
    assert [r.crse_code for r in fitted.transform(text).collect()] == [1.0, 0.0, 2.0]


def test_constant_column_is_not_scaled(spark, data):
    flat = data.withColumn("credits", F.lit(3))
    stages = features.fit_preprocessing(flat, features.min_features(flat))
    assert rows(stages.transform(flat).select("credits_scaled").distinct()) == [(0.0,)]


def test_min_and_rich_features(spark):
    df = spark.range(200).selectExpr(
        "202540 as Term", "'A' as subj", "id as crse", "3 as credits", "'x' as kind", "cast(id as string) as code",
        "id as student_id", "'r' as residency", "double(id) as load", "id as act", "id as act_enrollment", "id > 5 as flag",
        "date_add(date'2025-01-01', int(id)) as day",
    )
    assert features.min_features(df) == ["Term", "subj", "crse", "credits"]
    rich = features.rich_features(df)
    assert rich == ["Term", "subj", "crse", "credits", "kind", "load", "flag", "day"]
    scaled = features.fit_preprocessing(df, rich).transform(df)
    mean, deviation = scaled.selectExpr("avg(day_scaled)", "stddev_pop(flag_scaled)").first()
    assert (mean, deviation) == (pytest.approx(0, abs=1e-9), pytest.approx(1))
    assert features.min_features(df.withColumn("sec", F.lit("1"))) == ["Term", "subj", "crse", "sec", "credits"]
    # "residency" contains "id", so it counts as an id column unless the words are changed.
    assert "residency" in features.rich_features(df, id_words=("guid", "_id"))
    assert features.min_features(df.withColumnRenamed("Term", "Semester"))[0] == "Semester"


def test_forest(spark, data):
    fitted = models.fit(data, "tree", grid={"numTrees": (10,), "maxDepth": (4, 8)}, fold_by=("subj", "crse"))
    assert len(fitted.info["cv_mse"]) == 2
    weights = models.feature_importance(spark, fitted).collect()
    assert sum(r.importance for r in weights) == pytest.approx(1.0)
    assert [r.importance for r in weights] == sorted((r.importance for r in weights), reverse=True)
    report = {r.part: r for r in models.fit_report(data, fitted).collect()}
    assert set(report) == {"train", "validation"} and report["train"].r2 > 0
    assert models.validation_accuracy(data, fitted).count() > 0


def test_full_grids_are_the_fixed_ones():
    assert models.ALPHAS == (0.1, 1.0, 10.0, 100.0, 1000.0)
    sizes = [len(v) for v in models.FULL_FOREST.values()]
    assert sizes == [3, 4, 3, 3]  # 108 points


def test_unknown_kind(data):
    with pytest.raises(ValueError, match="unknown"):
        models.fit(data, "neural")


def test_save_and_load(spark, data, ridge, tmp_path):
    models.save_model(spark, ridge, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    assert loaded.info == ridge.info
    assert rows(models.predict(data, loaded)) == rows(models.predict(data, ridge))


def test_missing_feature_column(data, ridge):
    with pytest.raises(ValueError, match="credits"):
        models.predict(data.drop("credits"), ridge)


def test_scores_go_to_their_own_rows(spark, sections, ridge):
    raw = sections.filter("term = 199940").select("term", "subj", "crse", "sec", "act", "credits").orderBy(F.rand(1))
    out = scoring.score_rows(raw, ridge)
    assert out.count() == raw.count()
    by_key = {tuple(r)[:3]: r.prediction for r in scoring.score(raw, ridge).collect()}
    for r in out.collect():
        assert r.prediction == by_key[(r.term, r.subj, r.crse)]
    assert sorted(r["index"] for r in out.collect()) == list(range(out.count()))


def test_score_query_fills_defaults(spark, sections, ridge):
    text = "select distinct term as TERM, subj, crse from {s} where term = :t"
    out = scoring.score_query(spark, text, ridge, {"t": 199940}, s=sections)
    row = out.first()
    assert (row.act, row.credits) == (0, 3) and row.prediction is not None


def test_score_course(spark, sections, ridge):
    known = sections.groupBy("term", "subj", "crse").agg(F.sum("act").alias("total")).orderBy("term").first()
    past = scoring.score_course(spark, sections, ridge, known.subj, str(known.crse), known.term).first()
    assert past.total_act == known.total and past.error == pytest.approx(abs(past.prediction - known.total))
    coming = scoring.score_course(spark, sections, ridge, "PROMO", 999, 203040).first()
    assert (coming.credits, coming.total_act, coming.error) == (3, None, None)


def test_score_subject_term(sections, ridge):
    out = scoring.score_subject_term(sections, ridge, "PROMO", 199940)
    want = sections.filter("subj = 'PROMO' and term = 199940").select("subj", "crse").distinct().count()
    assert out.count() == want


def test_train_saves_under_its_name(spark, sections, tmp_path):
    fitted = training.train(
        spark, sections, [199940, 199910], "linear", model_dir=str(tmp_path), grid={"alpha": (1.0,)}
    )
    assert fitted.info["name"] == "enrollment_tree_min_linear_fall_1999_to_spring_1999"
    loaded = models.load_model(spark, str(tmp_path / fitted.info["name"]))
    assert loaded.info["terms"] == [199910, 199940]
    assert training.model_name([202230, 202140], "tree", "rich") == "enrollment_tree_rich_tree_spring_2021_to_term30_2022"


def test_score_rebuilds_context_and_grain(spark, sections):
    some = sections.filter("term < 199600")
    context = {"c": some.groupBy("term").agg(F.count("*").cast("double").alias("size"))}
    rich = models.fit(training.features_with_context(some, context, None), "linear", "rich", grid={"alpha": (1.0,)})
    assert "c_size" in rich.features
    scored = scoring.score(some, rich, context)
    assert scored.filter("prediction is null").count() == 0 and scored.count() > 0
    grain = models.fit(aggregates.course_term(some, "section"), "linear", grid={"alpha": (1.0,)})
    assert "sec" in grain.features
    assert scoring.score(some, grain).count() == some.count()


def test_missing_features_are_the_mean(spark, sections, tmp_path):
    data = aggregates.course_term(sections)
    fitted = models.fit(data, "linear", grid={"alpha": (1.0,)})
    holes = data.withColumn("credits", F.when(F.col("crse") % 2 == 0, F.col("credits")))
    models.predict(holes, fitted).write.parquet(str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored")).filter("prediction is null").count() == 0


def test_rows_without_a_key_stay(spark, sections):
    fitted = models.fit(aggregates.course_term(sections), "linear", grid={"alpha": (1.0,)})
    rows = sections.limit(5).unionByName(sections.limit(1).withColumn("subj", F.lit(None).cast("string")))
    scored = scoring.score_rows(rows, fitted)
    assert scored.count() == 6 and scored.filter("prediction is null").count() == 1


def test_wide_ridge_search_is_one_job(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 300))
    y = x[:, 0] * 2 + rng.normal(size=400)
    rows = [(int(k % 3), *map(float, x[k]), float(y[k])) for k in range(400)]
    names = [f"c{k}" for k in range(300)]
    encoded = spark.createDataFrame(rows, ["fold", *names, "label"]).repartition(4).cache()
    encoded.count()
    spark.sparkContext.setJobGroup("wide-ridge", "")
    got = models.moments(encoded, names)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("wide-ridge")) <= 2  # the second reads the shuffle of the first
    spark.sparkContext.setJobGroup("", "")
    for fold in range(3):
        part = np.column_stack([np.ones(400), x, y])[np.arange(400) % 3 == fold]
        assert np.allclose(got[fold], part.T @ part)
    errors = models.ridge_errors(encoded, names, [1.0, 1000.0])
    assert len(errors) == 2 and all(e > 0 for e in errors)
