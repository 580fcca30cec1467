"""Alignment of feature and target matrices on samples.

A matrix here is long: ``(cohort, sample_id, occ, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import clean_feature_id, clean_sample_id, has_digit_and_letter
from assayframe.operators.combine import OCCURRENCE
from assayframe.operators.joins import checked_broadcast, first_per_key

# Labels of the value blocks, axis names that mean samples, and
# the largest share of missing features a sample may have.
PREFERRED_BLOCK = "raw"
META_BLOCK = "meta"
SAMPLE_AXIS_NAMES = ("sample", "sample_id", "patient_id")
MAX_MISSING = 0.2


def select_value_type(cells: DataFrame, prefer: str = PREFERRED_BLOCK) -> DataFrame:
    """Keep the preferred block; without it everything but ``meta``."""
    block = F.col("value_type")
    preferred = cells.agg(F.max(F.coalesce(block == prefer, F.lit(False)))).scalar()
    return cells.filter(
        F.when(preferred, block == prefer).otherwise(
            F.coalesce(block != META_BLOCK, F.lit(True))
        )
    )


def feature_matrix(cells: DataFrame) -> DataFrame:
    """Cells keyed by cleaned feature name; features of the same name are
    averaged, nameless ones dropped."""
    named = cells.select(
        "cohort",
        clean_sample_id(F.col("sample_id")).alias("sample_id"),
        "occ",
        clean_feature_id(F.col("feature_name")).alias("feature"),
        "value",
    ).filter(F.col("feature") != "")
    return named.groupBy(*OCCURRENCE, "feature").agg(F.avg("value").alias("value"))


def common_samples(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples of both matrices. Each side is reduced to its samples before the
    two meet: an intersection alone would shuffle every cell."""
    own = left.select("sample_id").distinct()
    return own.intersect(right.select("sample_id").distinct())


def sample_missingness(matrix: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Features missing per sample occurrence, out of the union over cohorts.

    ``features`` lists the feature names when some have no value anywhere."""
    listed = matrix if features is None else features
    n_features = listed.agg(F.countDistinct("feature")).scalar()
    observed = matrix.groupBy(*OCCURRENCE).agg(F.count("value").alias("_n"))
    return observed.select(
        *OCCURRENCE,
        (n_features - F.col("_n")).alias("n_missing"),
        n_features.alias("n_features"),
    )


def complete_samples(
    matrix: DataFrame,
    other: DataFrame,
    max_missing: float = MAX_MISSING,
    features: DataFrame | None = None,
) -> DataFrame:
    """Samples of both matrices whose missing share is at most ``max_missing``.

    A sample stays if any of its occurrences passes; the least missing count is
    reported. The comparison is in whole numbers, as the limit itself is a
    common value.
    """
    limit = Fraction(str(max_missing))
    best = (
        sample_missingness(matrix, features)
        .groupBy("sample_id")
        .agg(F.min("n_missing").alias("n_missing"), F.first("n_features").alias("n_features"))
    )
    passing = best.filter(
        F.col("n_missing") * limit.denominator <= F.col("n_features") * limit.numerator
    )
    return passing.join(other.select("sample_id").distinct(), "sample_id", "left_semi")


def requested_targets(spark: SparkSession, targets: Sequence[str]) -> DataFrame:
    """Targets in the order asked for, blanks dropped."""
    names = [name.strip() for name in targets if name.strip()]
    if not names:
        raise ValueError("no targets given")
    return spark.createDataFrame(list(enumerate(names)), "ord int, target string")


def resolve_targets(targets: DataFrame, matrix: DataFrame) -> DataFrame:
    """Find each target among the feature names: exactly, else ignoring case,
    where the last of several spellings in sorted order wins. Targets that are
    not found stay, unresolved."""
    names = matrix.select("feature").distinct()
    asked = checked_broadcast(targets.select("target").distinct())
    matches = names.join(asked, F.lower("feature") == F.lower("target")).groupBy("target").agg(
        F.max(F.when(F.col("feature") == F.col("target"), F.col("feature"))).alias("_exact"),
        F.max("feature").alias("_any"),
    )
    return targets.join(matches, "target", "left").select(
        *targets.columns,
        F.coalesce("_exact", "_any").alias("resolved"),
        F.col("_any").isNotNull().alias("found"),
    )


def target_values(resolved: DataFrame, matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """``(target, sample_id, y)`` over ``samples``: missing values dropped, the
    first occurrence of a sample kept."""
    wanted = checked_broadcast(resolved.filter("found").select("target", "resolved").distinct())
    values = (
        matrix.filter(F.col("value").isNotNull())
        .join(wanted, F.col("feature") == F.col("resolved"))
        .join(samples.select("sample_id"), "sample_id", "left_semi")
    )
    return first_per_key(values, ["target", "sample_id"], ["cohort", "occ"]).select(
        "target", "sample_id", F.col("value").alias("y")
    )


def first_occurrences(matrix: DataFrame) -> DataFrame:
    """The occurrence that stands for each sample. Cells are reduced to their
    occurrences by hash before the ordered minimum, which would sort them."""
    seen = matrix.select(*OCCURRENCE).distinct()
    firsts = seen.groupBy("sample_id").agg(F.min(F.struct("cohort", "occ")).alias("_o"))
    return firsts.select("_o.cohort", "sample_id", "_o.occ")


def align_target(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """Observed features next to ``y``: ``(target, sample_id, feature, x, y)``.

    The first occurrence of each sample is looked up on the labels, so cells
    take part in a single join, and stay in place while the labels fit the
    broadcast bounds.
    """
    placed = checked_broadcast(labels.join(first_occurrences(matrix), "sample_id"))
    cells = matrix.filter(F.col("value").isNotNull()).withColumnRenamed("value", "x")
    return cells.join(placed, list(OCCURRENCE)).select(
        *labels.columns, "feature", "x"
    )


def infer_orientation(
    cells: DataFrame,
    row_label: str,
    row_order: str,
    column_label: str,
    column_order: str,
    row_axis: str | None = None,
    column_axis: str | None = None,
) -> DataFrame:
    """Which axis of a foreign matrix holds samples, as one row.

    An axis looks like samples by its name, or when its first label mixes digits
    and letters. If exactly one axis does, it decides; otherwise the matrix is
    transposed when it has more columns than rows.
    """
    # Rows and columns are told apart by their ordinals: labels may repeat. Each
    # axis is reduced to its members first.
    axes = None
    for axis, label, order in ((0, row_label, row_order), (1, column_label, column_order)):
        members = cells.groupBy(F.col(order).cast("string").alias("_ord")).agg(
            F.min(order).alias("_at"), F.min(F.col(label).cast("string")).alias("_label")
        )
        found = members.agg(
            F.min_by("_label", "_at").alias("_label"), F.count(F.lit(1)).alias("_n")
        ).withColumn("_axis", F.lit(axis))
        axes = found if axes is None else axes.unionByName(found)

    def of(axis: int, name: str):
        return F.max(F.when(F.col("_axis") == axis, F.col(name)))

    seen = axes.agg(
        of(0, "_label").alias("_row"),
        of(1, "_label").alias("_column"),
        of(0, "_n").alias("n_rows"),
        of(1, "_n").alias("n_cols"),
    )

    def looks_like_samples(axis: str | None, label: str):
        if str(axis or "").lower() in SAMPLE_AXIS_NAMES:
            return F.lit(True)
        return F.coalesce(has_digit_and_letter(F.col(label)), F.lit(False))

    rows, columns = F.col("rows_look_like_samples"), F.col("cols_look_like_samples")
    return seen.select(
        looks_like_samples(row_axis, "_row").alias("rows_look_like_samples"),
        looks_like_samples(column_axis, "_column").alias("cols_look_like_samples"),
        "n_rows",
        "n_cols",
    ).withColumn(
        "transpose",
        F.when(rows != columns, rows).otherwise(F.col("n_cols") > F.col("n_rows")),
    )


def oriented(
    cells: DataFrame, row_axis: str | None = None, column_axis: str | None = None
) -> DataFrame:
    """``(sample_id, feature, value)`` of a foreign matrix ``(row, row_ord,
    column, column_ord, value)``, whichever way it was laid out."""
    decision = infer_orientation(
        cells, "row", "row_ord", "column", "column_ord", row_axis, column_axis
    )
    rows_are_samples = decision.select("transpose").scalar()
    return cells.select(
        F.when(rows_are_samples, F.col("row")).otherwise(F.col("column")).alias("sample_id"),
        F.when(rows_are_samples, F.col("column")).otherwise(F.col("row")).alias("feature"),
        "value",
    )
