"""Quality control of cohort tables.

A table is one (assay, cohort). Cells hold non-missing values only, so missing
counts come from the sample and feature dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import ratio_or_zero
from assayframe.operators.combine import table_shapes
from assayframe.operators.joins import checked_broadcast
from assayframe.operators.quantiles import weighted_median
from assayframe.operators.ranking import seeded_digest, top_per_group
from assayframe.sources.scratch import materialize

TABLE = ("assay", "cohort")
SAMPLE = ("sample_id", "occ")

# Bins of a histogram, and rows and columns of a value sample.
HISTOGRAM_BINS = 40
SAMPLE_ROWS = 200
SAMPLE_COLUMNS = 2000


def with_both_assays(samples: DataFrame) -> DataFrame:
    """Cohorts that have a table for each of two assays."""
    assays = samples.groupBy("cohort").agg(
        F.min("assay").alias("_a"), F.max("assay").alias("_b")
    )
    return assays.filter(F.col("_a") != F.col("_b")).select("cohort")


def _observed(members: DataFrame | None, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed cells per member of a dimension, in one pass over the cells.

    A member without any cell is kept by a zero row from ``members``, where that
    is given; the union is aggregated once, so no join of cells is needed.
    """
    seen = cells.select(*keys, F.col("value").isNotNull().cast("int").alias("_n"))
    if members is not None:
        seen = seen.unionByName(members.select(*keys, F.lit(0).alias("_n")))
    return seen.groupBy(*keys).agg(F.sum("_n").alias("_n"))


def _missing(per_member: DataFrame, shapes: DataFrame, other: str) -> DataFrame:
    """Tally of members by missing count: ``(table, missing, members, other)``."""
    tally = per_member.groupBy(*TABLE, "_n").agg(F.count(F.lit(1)).alias("members"))
    return tally.join(shapes.select(*TABLE, F.col(other).alias("_of")), list(TABLE)).select(
        *TABLE, (F.col("_of") - F.col("_n")).alias("missing"), "members", "_of"
    )


def _fractions(tally: DataFrame, prefix: str) -> DataFrame:
    """Mean and median missing fraction over members of each table."""
    mean = tally.groupBy(*TABLE).agg(
        ratio_or_zero(
            F.sum(F.col("missing") * F.col("members")),
            F.sum(F.col("_of") * F.col("members")),
        ).alias(f"{prefix}_missing_mean"),
        F.max("_of").alias("_of"),
    )
    middle = weighted_median(tally, TABLE, "missing", "members", "_middle")
    return mean.join(middle, list(TABLE)).select(
        *TABLE,
        f"{prefix}_missing_mean",
        ratio_or_zero(F.col("_middle"), F.col("_of")).alias(f"{prefix}_missing_median"),
    )


def table_quality(
    cells: DataFrame,
    samples: DataFrame | None,
    features: DataFrame | None,
    feature: Sequence[str],
) -> DataFrame:
    """Missing count and fraction of each table, and the mean and median of the
    missing fraction over its samples and over its features. Only cohorts with
    both assays are reported. Without ``samples`` or ``features`` that dimension is
    what the cells hold."""
    # A pass over the cells for each dimension, which also gives its members.
    per_sample = materialize(_observed(samples, cells, [*TABLE, *SAMPLE]), "per_sample")
    per_feature = materialize(_observed(features, cells, [*TABLE, *feature]), "per_feature")
    paired = with_both_assays(per_sample)
    shapes = checked_broadcast(
        table_shapes(per_sample, per_feature).join(paired, "cohort", "left_semi")
    )
    by_sample = materialize(_missing(per_sample, shapes, "n_cols"), "by_sample")
    by_feature = materialize(_missing(per_feature, shapes, "n_rows"), "by_feature")
    counts = by_sample.groupBy(*TABLE).agg(
        F.sum(F.col("missing") * F.col("members")).alias("missing_count")
    )
    total = F.col("n_rows") * F.col("n_cols")
    return (
        shapes.join(counts, list(TABLE), "left")
        .withColumn("missing_count", F.coalesce("missing_count", F.lit(0)))
        .withColumn("missing_fraction", ratio_or_zero(F.col("missing_count"), total))
        .join(_fractions(by_sample, "per_sample"), list(TABLE), "left")
        .join(_fractions(by_feature, "per_feature"), list(TABLE), "left")
    )


def sample_overlap(samples: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct samples of two assays per cohort and how many they share."""
    seen = samples.groupBy("cohort", "sample_id").agg(
        F.max((F.col("assay") == first).cast("int")).alias("_f"),
        F.max((F.col("assay") == second).cast("int")).alias("_s"),
    )
    counts = seen.groupBy("cohort").agg(
        F.sum("_f").alias("rna_samples"),
        F.sum("_s").alias("protein_samples"),
        F.sum(F.col("_f") * F.col("_s")).alias("overlap_samples"),
    )
    share = F.col("overlap_samples")
    return counts.withColumns(
        {
            "overlap_fraction_rna": ratio_or_zero(share, F.col("rna_samples")),
            "overlap_fraction_protein": ratio_or_zero(share, F.col("protein_samples")),
        }
    )


def value_histogram(cells: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the least to the greatest value of each table, the
    last one closed; a single distinct value gets a range of one around it.
    Empty bins are listed with zero."""
    values = cells.filter(F.col("value").isNotNull())
    ranges = values.groupBy(*TABLE).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        *TABLE,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    )
    ranges = checked_broadcast(ranges)
    step = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = (
        values.join(ranges, list(TABLE))
        .groupBy(*TABLE, F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*TABLE, "bin"], "left").select(
        *TABLE,
        "bin",
        (F.col("_lo") + step * F.col("bin")).alias("lo"),
        (F.col("_lo") + step * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def sample_values(
    cells: DataFrame,
    samples: DataFrame,
    features: DataFrame,
    feature: Sequence[str],
    max_rows: int = SAMPLE_ROWS,
    max_columns: int = SAMPLE_COLUMNS,
    seed: int = 0,
) -> DataFrame:
    """Seeded sample of at most ``max_rows`` rows by ``max_columns`` columns of
    each table, for inspection. The histogram itself uses every value."""
    row_label = F.concat_ws("|", *SAMPLE)
    column_label = F.concat_ws("|", *feature)
    rows = top_per_group(samples, TABLE, [seeded_digest(row_label, seed), *SAMPLE], max_rows)
    columns = top_per_group(
        features, TABLE, [seeded_digest(column_label, seed), *feature], max_columns
    )
    return cells.join(
        checked_broadcast(rows.select(*TABLE, *SAMPLE)), [*TABLE, *SAMPLE], "left_semi"
    ).join(
        checked_broadcast(columns.select(*TABLE, *feature)), [*TABLE, *feature], "left_semi"
    )
