"""From cohort tables to one combined table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import safe_divide
from assayframe.operators.joins import checked_broadcast

FEATURE = ("feature_name", "database_id")
OCCURRENCE = ("cohort", "sample_id", "occ")


def tag_cohort(cells: DataFrame, cohort: str) -> DataFrame:
    """Add the cohort unless the table already carries one."""
    if "cohort" in cells.columns:
        return cells
    return cells.withColumn("cohort", F.lit(cohort))


def collapse_transcripts(cells: DataFrame) -> DataFrame:
    """Mean over the transcripts of a gene in each sample occurrence.

    One hash aggregate with partial means; the key holds the sample, so a
    feature or sample with many rows is still spread out.
    """
    keyed = cells.filter(F.col("feature_name").isNotNull() & F.col("database_id").isNotNull())
    return keyed.groupBy(*OCCURRENCE, *FEATURE).agg(F.avg("value").alias("value"))


def combine_cohorts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Append cohort tables. In long form the outer union of features is a
    plain union: a feature a cohort lacks simply has no cells there."""
    if not tables:
        raise ValueError("no cohort tables to combine")
    tagged = [tag_cohort(table, name) for name, table in sorted(tables.items())]
    return reduce(DataFrame.unionByName, tagged)


def feature_moments(cells: DataFrame, feature: Sequence[str] = FEATURE) -> DataFrame:
    """Mean and sample deviation per feature over all cohorts; zero deviation
    counts as missing."""
    return cells.groupBy(*feature).agg(
        F.avg("value").alias("mean"),
        F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    )


def zscore(
    cells: DataFrame, feature: Sequence[str] = FEATURE, moments: DataFrame | None = None
) -> DataFrame:
    """Add ``z``: each value against its feature over all cohorts jointly.

    Only the per-feature moments move; the cells are not shuffled while those
    fit the broadcast bounds. A missing id is a key like any other.
    """
    stats = feature_moments(cells, feature) if moments is None else moments
    keyed = stats.select(*[F.col(c).alias(f"_{c}") for c in feature], "mean", "std")
    side = checked_broadcast(keyed)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in feature))
    z = safe_divide(F.col("value") - F.col("mean"), F.col("std"))
    joined = cells.join(side, same).withColumn("z", z)
    return joined.drop("mean", "std", *[f"_{c}" for c in feature])


def value_blocks(scored: DataFrame) -> DataFrame:
    """One row per value type: the ``raw`` and ``z`` blocks side by side become
    rows; missing z-scores stay as NULL."""
    keep = [name for name in scored.columns if name not in ("value", "z")]
    return scored.select(
        *keep, F.expr("stack(2, 'raw', value, 'z', z) AS (value_type, value)")
    )


def sample_dimension(cells: DataFrame, table: Sequence[str] = ("assay",)) -> DataFrame:
    return cells.select(*table, *OCCURRENCE).distinct()


def feature_dimension(
    cells: DataFrame,
    table: Sequence[str] = ("assay", "cohort"),
    feature: Sequence[str] = FEATURE,
) -> DataFrame:
    return cells.select(*table, *feature).distinct()


def table_shapes(
    samples: DataFrame, features: DataFrame, table: Sequence[str] = ("assay", "cohort")
) -> DataFrame:
    """Rows and columns per table, from its two dimensions."""
    both = samples.select(
        *table, F.lit(1).alias("_row"), F.lit(0).alias("_col")
    ).unionByName(features.select(*table, F.lit(0).alias("_row"), F.lit(1).alias("_col")))
    return both.groupBy(*table).agg(
        F.sum("_row").alias("n_rows"), F.sum("_col").alias("n_cols")
    )
