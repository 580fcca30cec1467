"""Seeded train/test split and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.ranking import seeded_position

# Fixed values of a run.
TEST_SHARE = 0.2
SEED = 42
FOLDS = 5


def train_test_split(
    rows: DataFrame,
    group: Sequence[str] = ("target",),
    label: str = "sample_id",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Mark the first ``ceil(test_share * n)`` rows of a seeded shuffle as test.

    Adds ``split`` and, for training rows, their 1-based ``train_position`` and
    the number of training rows ``n_train``.
    """
    placed = seeded_position(rows, group, label, seed, "_position", "_rows")
    n_test = F.ceil(F.lit(float(test_share)) * F.col("_rows"))
    testing = F.col("_position") <= n_test
    return placed.withColumns(
        {
            "split": F.when(testing, F.lit("test")).otherwise(F.lit("train")),
            "train_position": F.when(~testing, F.col("_position") - n_test),
            "n_train": F.col("_rows") - n_test,
        }
    ).drop("_position", "_rows")


def fold_number(folds: int = FOLDS) -> Column:
    """Fold of a training row from its position: contiguous folds numbered from
    0, of which the first ``n_train % folds`` hold one row more. NULL for test
    rows."""
    size, larger = F.floor(F.col("n_train") / folds), F.col("n_train") % folds
    start = F.col("train_position") - 1
    edge = larger * (size + 1)
    in_larger = F.floor(start / (size + 1))
    in_rest = larger + F.floor(F.try_divide(start - edge, size))
    return F.when(start < edge, in_larger).otherwise(in_rest).cast("int")


def assign_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Training rows with their fold."""
    return rows.filter(F.col("split") == "train").withColumn("fold", fold_number(folds))
