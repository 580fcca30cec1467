"""Fixed schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

RNA = "transcriptomics"
PROTEIN = "proteomics"

CELLS = T.StructType(
    [
        T.StructField("assay", T.StringType()),
        T.StructField("cohort", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("occ", T.LongType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("database_id", T.StringType()),
        T.StructField("transcript_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("baseline_r2", T.DoubleType()),
        T.StructField("baseline_mae", T.DoubleType()),
        T.StructField("baseline_pearson", T.DoubleType()),
        T.StructField("rf_r2", T.DoubleType()),
        T.StructField("rf_mae", T.DoubleType()),
        T.StructField("rf_pearson", T.DoubleType()),
        T.StructField("rf_best_cv_r2", T.DoubleType()),
        T.StructField("rf_best_params", T.StringType()),
        T.StructField("target_rna_in_top50", T.BooleanType()),
    ]
)

IMPORTANCES = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
)

GAPS = T.StructType(
    [
        T.StructField("driver", T.StringType()),
        T.StructField("control", T.StringType()),
        T.StructField("accuracy_gap_rf_r2", T.DoubleType()),
    ]
)

RUN_EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("elapsed_sec", T.DoubleType()),
        T.StructField("target_elapsed_sec", T.DoubleType()),
    ]
)
