from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from assayframe.operators import models, ridge, search
from assayframe.plans import modelling as plan
from assayframe.schema import METRICS
from assayframe.sources import sinks

GRID = {
    "model__n_estimators": [5, 8],
    "model__max_depth": [20, 3],
    "model__min_samples_leaf": [1],
    "model__max_features": ["sqrt", 0.5],
    "model__bootstrap": [True],
}


def problem(spark, n=60, p=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=n) * 0.3
    seen = np.ones((n, p), dtype=bool)
    seen[np.arange(0, n, 3), rng.integers(0, p, size=len(range(0, n, 3)))] = False
    schema = "cohort string, sample_id string, occ long, feature string, value double"
    rna = spark.createDataFrame(
        [("a", f"S{i}", 0, f"g{j}", float(x[i, j])) for i in range(n) for j in range(p) if seen[i, j]], schema
    )
    data = [("a", f"S{i}", 0, "KRAS", float(y[i])) for i in range(n)]
    data += [("a", f"S{i}", 0, "GAPDH", float(-y[i])) for i in range(n - 10)]
    data += [("a", "S0", 0, "EMPTY", None)]
    return rna, spark.createDataFrame(data, schema)


def fits_of(spark, x, y, target="t"):
    return spark.createDataFrame(
        [(target, 0, "train", [float(v) for v in row], float(t)) for row, t in zip(x, y)],
        "target string, fit int, role string, scaled array<double>, y double",
    )


@pytest.mark.parametrize("width, tile", [(3, 512), (5, 2), (7, 3), (300, 512)])
def test_ridge_closed_form(spark, width, tile):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, width)) + 3
    y = x[:, :5] @ np.arange(1, 6)[:width] + rng.normal(size=40) + 7
    both = fits_of(spark, x, y).unionByName(fits_of(spark, x[:25], -y[:25], "other")).repartition(4)
    found = {r.target: r for r in ridge.fit_ridges(both, side=tile).collect()}
    for target, rows, sign in (("t", slice(None), 1), ("other", slice(25), -1)):
        z, label = x[rows] - x[rows].mean(0), sign * y[rows]
        expected = np.linalg.solve(z.T @ z + np.eye(width), z.T @ (label - label.mean()))
        assert np.allclose(found[target].coefficients, expected, atol=1e-7)
        assert found[target].intercept == pytest.approx(label.mean() - x[rows].mean(0) @ expected)


def test_ridge_hands_sums_on(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
    whole = ridge.fit_ridges(fits_of(spark, x, y)).first()
    parted = ridge.fit_ridges(fits_of(spark, x, y).repartition(7), most_bytes=0).first()
    assert np.allclose(whole.coefficients, parted.coefficients)


def test_ridge_with_constant_label(spark):
    model = ridge.fit_ridges(fits_of(spark, [[1.0], [2.0]], [3.0, 3.0])).first()
    assert model.intercept == 3.0 and model.coefficients == [0.0]
    nothing = fits_of(spark, [[1.0]], [1.0]).where("role = 'test'")
    assert ridge.fit_ridges(nothing).collect() == []


def test_parameter_draws(spark):
    draws = search.parameter_draws(spark, 30, 42).orderBy("draw").collect()
    assert [d.draw for d in draws] == list(range(1, 31))
    decoded = [json.loads(d.params) for d in draws]
    assert len({d.params for d in draws}) == 30
    for params in decoded:
        assert set(params) == set(search.GRID)
        assert all(value in search.GRID[name] for name, value in params.items())
    again = search.parameter_draws(spark, 30, 42).orderBy("draw").collect()
    assert [d.params for d in again] == [d.params for d in draws]
    assert search.parameter_draws(spark, 10**6, 1).count() == 3200
    assert search.parameter_draws(spark, 10**6, 1).select("params").distinct().count() == 3200


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    rna, protein = problem(spark)
    settings = plan.Settings(k_best=4, n_iter=2, grid=GRID, folds=3, save_models=f"{out}/models")
    result = plan.run_targets(rna, protein, ["KRAS", "gapdh", "NOPE", "EMPTY"], settings, out)
    return result, out


def test_run_metrics(finished):
    result, _ = finished
    got = {r.target: r for r in result.metrics.collect()}
    assert result.metrics.schema.fieldNames() == METRICS.fieldNames()
    assert set(got) == {"KRAS", "gapdh", "NOPE"}
    assert (got["KRAS"].n_samples, got["gapdh"].n_samples, got["NOPE"].n_samples) == (60, 50, 0)
    assert got["KRAS"].baseline_r2 > 0.8 and got["KRAS"].rf_best_cv_r2 is not None
    assert json.loads(got["KRAS"].rf_best_params).keys() == GRID.keys()
    assert got["NOPE"].rf_r2 is None and got["NOPE"].rf_best_params == ""
    assert got["NOPE"].target_rna_in_top50 is False


def test_run_baseline_equals_dense_ridge(spark, finished):
    result, _ = finished
    rna, protein = problem(spark)
    pdf = rna.toPandas().pivot(index="sample_id", columns="feature", values="value")
    y = protein.filter("feature = 'KRAS'").toPandas().set_index("sample_id")["value"]
    got = result.predictions.filter("target = 'KRAS' AND model = 'ridge'").toPandas().set_index("sample_id")
    test = list(got.index)
    train = [s for s in y.index if s not in test]
    median = pdf.loc[train].median()
    x_train, x_test, y_train = pdf.loc[train].fillna(median), pdf.loc[test].fillna(median), y[train]
    score = {c: np.corrcoef(x_train[c], y_train)[0, 1] ** 2 for c in pdf}
    top = sorted(score, key=score.get, reverse=True)[:4]
    mean, std = x_train[top].mean(), x_train[top].std(ddof=0)
    z = ((x_train[top] - mean) / std).to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y_train - y_train.mean()))
    expected = ((x_test[top] - mean) / std).to_numpy() @ w + y_train.mean()
    assert len(test) == 12
    assert np.allclose(got["prediction"].to_numpy(), expected, atol=1e-8)
    assert np.allclose(got["y"].to_numpy(), y[test].to_numpy())


def test_run_importances_and_reports(spark, finished):
    result, out = finished
    sums = dict(rows(result.importances.groupBy("target").agg(F.sum("importance"))))
    assert sums == pytest.approx({"KRAS": 1.0, "gapdh": 1.0})
    assert result.importances.filter("target = 'KRAS'").count() == 4
    best = result.top_features.filter("target = 'KRAS' AND rank = 1").first()
    assert best.feature == "g0"
    assert result.cv_scores.count() == 2 * 2 * 3
    assert spark.read.option("header", True).csv(f"{out}/metrics.csv").count() == 3
    events = spark.read.parquet(f"{out}/progress")
    assert rows(sinks.current_stage(events).select("stage")) == [("done",)]
    assert events.count() == 2 + 2 * 2 + 1
    done = events.filter("stage = 'target_done'").first()
    assert done.target_elapsed_sec <= done.elapsed_sec == round(done.elapsed_sec, 1)


@pytest.mark.parametrize("kind", ["forest", "ridge"])
def test_a_saved_pipeline_predicts_as_before(spark, finished, kind):
    result, out = finished
    rna, _ = problem(spark)
    before = result.predictions.filter(F.col("model") == kind).withColumnRenamed("prediction", "p")
    cells = rna.select("sample_id", "feature", F.col("value").alias("x"))
    samples = before.select("target", "sample_id")
    rows_ = models.sample_rows(samples, samples.join(cells, "sample_id"))
    again = PipelineModel.load(f"{out}/models/{kind}").transform(rows_)
    both = before.join(again.select("target", "sample_id", "prediction"), ["target", "sample_id"])
    assert both.count() == before.count() > 0
    assert both.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-9).isEmpty()


def test_pipelines_of_several_targets(spark, tmp_path):
    rng = np.random.default_rng(3)
    labels, cells = [], []
    for target, sign in (("a", 1), ("b", -1)):
        for i in range(40):
            x = rng.normal(size=5)
            labels.append((target, f"s{i}", float(sign * x[0] * 4)))
            cells += [(target, f"s{i}", f"g{j}", float(v)) for j, v in enumerate(x) if (i + j) % 7]
    labels = spark.createDataFrame(labels, "target string, sample_id string, y double")
    samples = models.sample_rows(labels, spark.createDataFrame(cells, "target string, sample_id string, feature string, x double"))
    model = models.ridge_pipeline(2).fit(samples)
    model.write().save(str(tmp_path / "ridge"))
    loaded = PipelineModel.load(str(tmp_path / "ridge"))
    first, second = (sorted(map(tuple, m.transform(samples).select("target", "sample_id", "prediction").collect())) for m in (model, loaded))
    assert first == second and len(first) == 80
    # A sample without any cell is filled with medians throughout.
    empty = spark.createDataFrame([("a", "x", None)], "target string, sample_id string, cells map<string,double>")
    medians = {r.feature: r.median for r in model.stages[0].frame.where("target = 'a'").collect()}
    assert sorted(model.transform(empty).first().features) == sorted(medians.values())
    forest = models.forest_pipeline(0, {"model__n_estimators": 3}).fit(samples)
    assert forest.transform(samples).where("prediction is null").isEmpty()
    assert forest.stages[0].frame.count() == 10


def test_a_failed_run_leaves_its_events(spark, tmp_path, monkeypatch):
    rna, protein = problem(spark, n=20)

    def broken(*_):
        raise ValueError("no fit")

    monkeypatch.setattr(plan.forests, "search", broken)
    settings = plan.Settings(k_best=2, n_iter=1, grid=GRID, folds=2)
    with pytest.raises(ValueError):
        plan.run_targets(rna, protein, ["KRAS"], settings, str(tmp_path))
    events = spark.read.parquet(f"{tmp_path}/progress").orderBy("seq").collect()
    assert [e.stage for e in events] == ["init", "loaded_inputs", "target_start", "failed: ValueError"]
    assert [e.seq for e in events] == [1, 2, 3, 4] and events[2].target == "KRAS"


def test_runs_from_files_choose_raw_values(spark, tmp_path):
    rna, protein = problem(spark, n=30)
    named = rna.withColumnRenamed("feature", "feature_name")
    named.withColumn("z", F.lit(99.0)).write.parquet(str(tmp_path / "rna"))
    protein.withColumnRenamed("feature", "feature_name").write.parquet(str(tmp_path / "protein"))
    settings = plan.Settings(k_best=3, n_iter=1, grid=GRID, folds=2)
    result = plan.run_files(spark, str(tmp_path / "rna"), str(tmp_path / "protein"), ["KRAS"], settings)
    direct = plan.run_targets(rna, protein, ["KRAS"], settings)
    assert rows(result.metrics.select("target", "n_samples")) == [("KRAS", 30)]
    a, b = result.metrics.first(), direct.metrics.first()
    assert a.baseline_r2 == pytest.approx(b.baseline_r2) and a.rf_r2 == pytest.approx(b.rf_r2)


def test_sweep_reuses_one_ranking(spark, tmp_path):
    rna, protein = problem(spark)
    settings = plan.Settings(n_iter=1, grid=GRID, folds=2)
    done = spark.createDataFrame([("KRAS", 3)], "target string, k int")
    results = plan.run_sweep(rna, protein, ["KRAS"], [2, 3, 5], settings, str(tmp_path), done)
    assert sorted(results) == [2, 5]
    small = {r.feature for r in results[2].importances.collect()}
    large = {r.feature for r in results[5].importances.collect()}
    assert len(small) == 2 and len(large) == 5 and small < large
    from assayframe.plans.elbow import elbow_report

    report = elbow_report(spark, [f"{tmp_path}/outputs*"])
    assert rows(report.elbow.select("protein", "k"), "k") == [("KRAS", 2), ("KRAS", 5)]
    assert plan.run_sweep(rna, protein, ["KRAS"], [3], settings, None, done) == {}


def test_no_common_samples(spark):
    rna, protein = problem(spark, n=20)
    with pytest.raises(RuntimeError):
        plan.run_targets(rna, protein.withColumn("sample_id", F.lit("other")), ["KRAS"])
