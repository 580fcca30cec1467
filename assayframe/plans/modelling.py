"""From two aligned matrices to fitted models, metrics and reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from types import TracebackType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import elapsed_seconds
from assayframe.operators import (
    align,
    combine,
    design,
    forests,
    models,
    reports,
    ridge,
    search,
    selection,
    split,
)
from assayframe.operators.ranking import top_per_group
from assayframe.schema import METRICS
from assayframe.sources.scratch import materialize
from assayframe.sources.sinks import append_events, write_csv

DEFAULT_K = 2000


@dataclass(frozen=True)
class Settings:
    """Parameters of a run. ``k_best=None`` turns feature selection off. Fits of more
    than ``local_cells`` cells are grown level by level, with ``bins`` thresholds per
    feature."""

    k_best: int | None = DEFAULT_K
    test_share: float = split.TEST_SHARE
    max_missing: float = align.MAX_MISSING
    seed: int = split.SEED
    folds: int = split.FOLDS
    n_iter: int = search.DRAWS
    grid: Mapping[str, Sequence] = field(default_factory=lambda: search.GRID)
    local_cells: int = forests.LOCAL_CELLS
    bins: int = forests.MAX_BINS
    save_models: str | None = None


@dataclass(frozen=True)
class Prepared:
    """Materialised input of the fits."""

    resolved: DataFrame
    rows: DataFrame
    selected: DataFrame
    design: DataFrame


@dataclass(frozen=True)
class Result:
    metrics: DataFrame
    ordered: DataFrame
    top_features: DataFrame
    importances: DataFrame
    predictions: DataFrame
    cv_scores: DataFrame
    gaps: DataFrame


class RunLog:
    """Append-only progress of a run, at a path or nowhere.

    Events are on disk when ``note`` returns, those of a stage in one file, so that a
    run that fails leaves every stage it reached, and the failure itself as the last.
    """

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path
        self.run_id, self.started = uuid.uuid4().hex, time.time()
        self.seq = 0

    def note(self, stage: str, targets: Iterable[str | None] = (None,), since: float | None = None) -> None:
        """An event of the run, or one for each of some targets, begun at ``since``."""
        now, rows = time.time(), []
        for target in targets:
            self.seq += 1
            rows.append((self.run_id, self.seq, stage, target, self.started, since, now))
        if self.path and rows:
            schema = "run_id string, seq long, stage string, target string, _run double, _own double, _now double"
            events = self.spark.createDataFrame(rows, schema).withColumns(
                {
                    "elapsed_sec": elapsed_seconds(F.col("_run"), F.col("_now")),
                    "target_elapsed_sec": elapsed_seconds(F.col("_own"), F.col("_now")),
                }
            )
            append_events(events, self.path)

    def __enter__(self) -> "RunLog":
        return self

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        if kind is not None:
            self.note(f"failed: {kind.__name__}")


def prepare(
    rna: DataFrame,
    protein: DataFrame,
    targets: Sequence[str],
    settings: Settings = Settings(),
    features: DataFrame | None = None,
) -> Prepared:
    """Align, split, rank and assemble, for all targets in the same jobs.

    Both matrices are read several times and should be stored tables.
    ``features`` lists the features of the RNA table, so that those without any
    value count as missing.
    """
    spark = rna.sparkSession
    if align.common_samples(rna, protein).isEmpty():
        raise RuntimeError("the two matrices have no sample in common")
    resolved = materialize(
        align.resolve_targets(align.requested_targets(spark, targets), protein), "resolved"
    )
    kept = align.complete_samples(rna, protein, settings.max_missing, features)
    # The split numbers the labels and counts them, so it reads them twice.
    labels = materialize(align.target_values(resolved, protein, kept), "labels")
    placed = split.train_test_split(
        labels, test_share=settings.test_share, seed=settings.seed
    )
    rows = materialize(design.folded_rows(placed, settings.folds), "rows")
    observed = materialize(design.observed_cells(rows, rna), "observed")
    statistics = design.fit_statistics(observed, rows, settings.folds)
    selected = materialize(
        selection.rank_features(statistics, settings.k_best, design.FIT), "selected"
    )
    # Every fit reads its own folder of the design and nothing else.
    table = materialize(
        design.design_rows(rows, observed, selected, settings.folds), "design", design.FIT
    )
    return Prepared(resolved, rows, selected, table)


def fold_scores(
    prepared: Prepared, targets: DataFrame, draws: DataFrame, settings: Settings
) -> DataFrame:
    """``target, draw, fold, r2`` of every draw on every fold of every target, all from
    one job. A fold that can't be scored has a null score."""
    predicted = forests.search(
        prepared.design, draws, settings.seed, settings.local_cells, settings.bins
    )
    scored = reports.regression_metrics(predicted, ["target", "draw", "fit"]).select(
        "target", "draw", F.col("fit").alias("fold"), "r2"
    )
    folds = F.sequence(F.lit(0), F.lit(settings.folds - 1))
    asked = search.search_plan(targets, draws).select("target", "draw", F.explode(folds).alias("fold"))
    return materialize(asked.join(scored, ["target", "draw", "fold"], "left"), "scores")


def best_draws(scores: DataFrame) -> DataFrame:
    """Mean fold score per draw, the best draw of each target marked."""
    means = reports.mean_scores(scores, ["target", "draw"])
    # Scores that differ by rounding only are the same.
    order = [F.round("mean_r2", 9).desc_nulls_last(), "draw"]
    return top_per_group(means, ["target"], order, 1).drop("rank")


def feature_importances(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Importances by name; a selected feature without any split has none."""
    found = forests.importances(nodes).select(
        "target", (F.col("feature") + 1).cast("long").alias("rank"), "importance"
    )
    names = selected.filter(F.col("fit") == design.FULL_FIT).select("target", "feature", "rank")
    return names.join(found, ["target", "rank"], "left").select(
        "target", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )


def fit_all(
    prepared: Prepared, settings: Settings, log: RunLog, keep_k: int | None = None
) -> Result:
    """Fit every target of a prepared run, for a smaller k if given. No step has a job
    per target, draw or fold."""
    if keep_k is not None and keep_k >= 2:
        # Below two there is no selection, see rank_features.
        prepared = replace(
            prepared,
            selected=prepared.selected.filter(F.col("rank") <= keep_k),
            design=design.first_features(prepared.design, keep_k),
        )
    spark = prepared.design.sparkSession
    draws = materialize(
        search.parameter_draws(spark, settings.n_iter, settings.seed, settings.grid), "draws"
    )
    targets = materialize(prepared.rows.select("target").distinct(), "targets")
    names = [row.target for row in targets.orderBy("target").collect()]
    begun = time.time()
    log.note("target_start", names)
    scores = fold_scores(prepared, targets, draws, settings)
    chosen = best_draws(scores).join(draws, "draw").select("target", "draw", "params")
    nodes, by_forest = forests.fit(
        prepared.design, materialize(chosen, "chosen"), settings.seed, settings.local_cells, settings.bins
    )
    full = prepared.design.filter(F.col("fit") == design.FULL_FIT)
    weights = materialize(ridge.fit_ridges(full), "ridge")
    by_ridge = ridge.predict(weights, full.filter("role = 'test'"))
    columns = ["target", "sample_id", "y", "prediction"]
    predictions = materialize(
        by_ridge.select(*columns, F.lit("ridge").alias("model"))
        .unionByName(by_forest.select(*columns, F.lit("forest").alias("model")))
        .select("target", "model", "sample_id", "y", "prediction"),
        "predictions",
    )
    importances = materialize(feature_importances(nodes, prepared.selected), "importances")
    if settings.save_models:
        forest_model = models.ForestRegressionModel(nodes)
        models.fitted(prepared.selected, forest_model).write().overwrite().save(f"{settings.save_models}/forest")
        ridge_model = models.RidgeRegressionModel(models.weights_of(weights))
        models.fitted(prepared.selected, ridge_model).write().overwrite().save(f"{settings.save_models}/ridge")
    log.note("target_done", names, begun)
    top = reports.top_features(importances)
    ordered = materialize(target_metrics(prepared, predictions, scores, draws, top), "metrics")
    metrics = ordered.select(*METRICS.fieldNames())
    # First row of each target; equal targets have equal rows.
    gaps = reports.accuracy_gap(metrics, "n_samples")
    return Result(metrics, ordered, top, importances, predictions, scores, gaps)


def target_metrics(
    prepared: Prepared, predictions: DataFrame, scores: DataFrame, params: DataFrame, top: DataFrame
) -> DataFrame:
    """One record per requested target, with its place. A target that was not found has no
    samples and no scores; one that was found without any value has no record."""
    by_model = reports.regression_metrics(predictions, ["target", "model"])

    def of(model: str, metric: str, name: str):
        return F.max(F.when(F.col("model") == model, F.col(metric))).alias(name)

    fitted = by_model.groupBy("target").agg(
        of("ridge", "r2", "baseline_r2"),
        of("ridge", "mae", "baseline_mae"),
        of("ridge", "pearson", "baseline_pearson"),
        of("forest", "r2", "rf_r2"),
        of("forest", "mae", "rf_mae"),
        of("forest", "pearson", "rf_pearson"),
    )
    sizes = prepared.rows.groupBy("target").agg(F.count(F.lit(1)).alias("n_samples"))
    best = best_draws(scores).join(params, "draw").select(
        "target",
        F.col("mean_r2").alias("rf_best_cv_r2"),
        F.col("params").alias("rf_best_params"),
    )
    own = reports.target_in_top(top).withColumnRenamed("in_top50", "target_rna_in_top50")
    joined = prepared.resolved
    for side in (sizes, fitted, best, own):
        joined = joined.join(side, "target", "left")
    return (
        joined.filter(~F.col("found") | F.col("n_samples").isNotNull())
        .withColumns(
            {
                "n_samples": F.coalesce("n_samples", F.lit(0).cast("long")),
                "rf_best_params": F.coalesce("rf_best_params", F.lit("")),
                "target_rna_in_top50": F.coalesce("target_rna_in_top50", F.lit(False)),
            }
        )
        .select("ord", *METRICS.fieldNames())
    )


def write_result(result: Result, out: str) -> None:
    """Report files of a run."""
    write_csv(result.ordered, f"{out}/metrics.csv", ["ord"], METRICS.fieldNames())
    write_csv(result.top_features, f"{out}/feature_importance.csv", ["target", "rank"])
    write_csv(result.gaps, f"{out}/accuracy_gap.csv")


def run_targets(
    rna: DataFrame,
    protein: DataFrame,
    targets: Sequence[str],
    settings: Settings = Settings(),
    out: str | None = None,
    features: DataFrame | None = None,
) -> Result:
    """Predict each target protein from RNA features: ridge baseline and a
    random forest found by random search."""
    with RunLog(rna.sparkSession, f"{out}/progress" if out else None) as log:
        log.note("init")
        prepared = prepare(rna, protein, targets, settings, features)
        log.note("loaded_inputs")
        result = fit_all(prepared, settings, log)
        if out:
            write_result(result, out)
        log.note("done")
    return result


def model_matrix(table: DataFrame) -> DataFrame:
    """Feature matrix of a combined table: of its blocks of values the raw one, or
    without it everything but ``meta``."""
    blocks = combine.value_blocks(table) if "z" in table.columns else table
    if "value_type" in blocks.columns:
        blocks = align.select_value_type(blocks).drop("value_type")
    return materialize(align.feature_matrix(blocks), "matrix")


def run_files(
    spark: SparkSession,
    rna: str,
    protein: str,
    targets: Sequence[str],
    settings: Settings = Settings(),
    out: str | None = None,
) -> Result:
    """:func:`run_targets` on the combined tables at two paths."""
    tables = [model_matrix(spark.read.parquet(path)) for path in (rna, protein)]
    return run_targets(*tables, targets, settings, out)


def _finished(spark: SparkSession, metrics: str) -> bool:
    """Whether a run left its metrics."""
    try:
        return not spark.read.text(metrics).isEmpty()
    except AnalysisException:
        return False


def run_sweep(
    rna: DataFrame,
    protein: DataFrame,
    targets: Sequence[str],
    ks: Sequence[int],
    settings: Settings = Settings(),
    out: str | None = None,
    done: DataFrame | None = None,
    features: DataFrame | None = None,
) -> dict[int, Result]:
    """Run for every k that has no metrics yet: below ``out``, or by ``done``.

    Matrices are aligned and features ranked once, to the largest k; smaller
    selections are prefixes. The first failure ends the sweep, finished runs
    stay.
    """
    if not ks:
        raise ValueError("no k values given")
    spark = rna.sparkSession
    asked = align.requested_targets(spark, targets)
    pending = sorted(set(ks))
    if done is not None:
        pending = sorted(
            row.k for row in selection.pending_runs(asked, ks, done).select("k").distinct().collect()
        )
    if out:
        pending = [k for k in pending if not _finished(spark, f"{out}/outputs_k{k}/metrics.csv")]
    if not pending:
        return {}
    largest = max(pending) if min(pending) >= 2 else None
    prepared = prepare(rna, protein, targets, replace(settings, k_best=largest), features)
    results = {}
    for k in pending:
        folder = f"{out}/outputs_k{k}" if out else None
        with RunLog(spark, f"{folder}/progress" if folder else None) as log:
            results[k] = fit_all(prepared, settings, log, keep_k=k)
            if folder:
                write_result(results[k], folder)
            log.note("done")
    return results
