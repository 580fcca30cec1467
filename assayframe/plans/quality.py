"""Quality report of raw cohort files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators import quality
from assayframe.schema import PROTEIN, RNA
from assayframe.sources.cells import RAW_FILE, cohort_tables, with_table_rows
from assayframe.sources.matrices import read_wide, wide_features, wide_samples
from assayframe.sources.scratch import materialize
from assayframe.sources.sinks import write_summary


@dataclass(frozen=True)
class QualityReport:
    tables: DataFrame
    overlap: DataFrame
    histogram: DataFrame


def _tagged(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "cohort": F.regexp_extract("path", RAW_FILE, 1),
            "assay": F.regexp_extract("path", RAW_FILE, 2),
        }
    ).drop("path")


def quality_report(
    spark: SparkSession, raw_root: str, out: str | None = None, index: str | None = None
) -> QualityReport:
    """Missingness, sample overlap and value histograms of all cohorts that have
    both assays. Columns are told apart by their full label."""
    found = cohort_tables(spark, raw_root)
    paired = found.join(quality.with_both_assays(found), "cohort", "left_semi")
    cells = with_table_rows(read_wide(spark, paired, index), paired)
    cells = materialize(_tagged(cells), "cells", ["assay"])
    rows = with_table_rows(wide_samples(paired, index), paired)
    samples = materialize(_tagged(rows), "samples")
    # Part files repeat the labels of their table.
    features = materialize(_tagged(wide_features(paired, index)).distinct(), "features")
    report = QualityReport(
        quality.table_quality(cells, samples, features, ["label"]),
        quality.sample_overlap(samples, RNA, PROTEIN),
        quality.value_histogram(cells),
    )
    if out:
        write_summary(report.tables, f"{out}/qc_tables.json")
        write_summary(report.overlap, f"{out}/qc_overlap.json")
        report.histogram.write.mode("overwrite").parquet(f"{out}/qc_histogram")
    return report
