"""Elbow report over the metrics of finished runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assayframe.operators import reports
from assayframe.sources.metrics import read_metrics
from assayframe.sources.scratch import materialize
from assayframe.sources.sinks import write_csv


@dataclass(frozen=True)
class ElbowReport:
    summary: DataFrame
    elbow: DataFrame
    knees: DataFrame


def elbow_report(
    spark: SparkSession, roots: Sequence[str], metric: str = "r2", out: str | None = None
) -> ElbowReport:
    """Mean and deviation of a metric per protein and k, the charted range of
    it, and the knee of every protein."""
    metrics = materialize(read_metrics(spark, roots), "metrics")
    summary = reports.metric_summary(metrics, metric)
    report = ElbowReport(
        summary, reports.elbow_table(metrics, metric), reports.detect_knee(summary)
    )
    if out:
        write_csv(report.summary, f"{out}/summary.csv", ["protein", "k"])
        write_csv(report.elbow, f"{out}/elbow.csv", ["protein", "k"])
    return report
