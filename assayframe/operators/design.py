"""Dense design rows for model fits, built from selected features only.

A *fit* is one training run: ``FULL_FIT`` trains on all training rows and
predicts the test rows, fit ``i`` leaves fold ``i`` out for validation. Medians
and ranking are refitted inside each fit, all of them in one job with the fit as
a grouping key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.align import align_target
from assayframe.operators.joins import checked_broadcast
from assayframe.operators.quantiles import merged_median, part_sketch
from assayframe.operators.selection import filled_statistics, label_totals
from assayframe.operators.split import FOLDS, fold_number
from assayframe.sources.scratch import materialize

FULL_FIT = -1
FIT = ("target", "fit")


def _fits(folds: int) -> Column:
    return F.array(*[F.lit(i) for i in (FULL_FIT, *range(folds))])


def folded_rows(placed: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``(target, sample_id, y, split, fold)``; test rows have no fold."""
    return placed.select("target", "sample_id", "y", "split", fold_number(folds).alias("fold"))


def fit_rows(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows of every fit with their role: train, valid or test."""
    fits = F.when(F.col("split") == "test", F.array(F.lit(FULL_FIT))).otherwise(_fits(folds))
    role = (
        F.when(F.col("fit") == FULL_FIT, F.col("split"))
        .when(F.col("fit") == F.col("fold"), F.lit("valid"))
        .otherwise(F.lit("train"))
    )
    return rows.withColumn("fit", F.explode(fits)).select(
        *FIT, role.alias("role"), "sample_id", "y"
    )


def _without(parts: Column, fit: Column) -> Column:
    """Moments of all folds but one, merged in the order of the folds."""

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        share, weight = b["n"] / n, a["n"] * b["n"] / n
        return F.struct(
            n.alias("n"),
            (a["mx"] + dx * share).alias("mx"),
            (a["my"] + dy * share).alias("my"),
            (a["sxx"] + b["sxx"] + dx * dx * weight).alias("sxx"),
            (a["sxy"] + b["sxy"] + dx * dy * weight).alias("sxy"),
        )

    zero = F.lit(0.0)
    nothing = F.struct(
        F.lit(0).cast("long").alias("n"),
        *[zero.alias(name) for name in ("mx", "my", "sxx", "sxy")],
    )
    return F.aggregate(F.filter(parts, lambda p: p["part"] != fit), nothing, merge)


def fit_statistics(
    observed: DataFrame, rows: DataFrame, folds: int = FOLDS, margin: float = 0.015
) -> DataFrame:
    """Feature statistics of the training rows of every fit. ``observed`` holds
    the cells of all rows, ``(rows columns, feature, x)``.

    Cells are summed once per fold; a fit merges the moments and quantile sketches of
    the folds it trains on, so that no cell is repeated for the fits it belongs to.
    """
    training = F.col("split") == "train"
    # Without folds there is the full fit only, and one part.
    part = F.coalesce(F.col("fold"), F.lit(0)) if folds else F.lit(0)
    cells = observed.filter(training & F.col("x").isNotNull()).withColumn("part", part)
    by_fold = cells.groupBy("target", "feature", "part").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        (F.var_pop("x") * F.count("x")).alias("sxx"),
        (F.covar_pop("x", "y") * F.count("x")).alias("sxy"),
        part_sketch("x").alias("sketch"),
    )
    fields = ["part", "n", "mx", "my", "sxx", "sxy", "sketch"]
    parts = materialize(
        by_fold.groupBy("target", "feature").agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("_parts")
        ),
        "folds",
    )
    fits = [FULL_FIT, *range(folds)]
    medians = merged_median(
        cells, ["target", "feature"], "x", "part", fits, parts, margin=margin
    )
    moments = (
        parts.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in fits])))
        .withColumn("_m", _without(F.col("_parts"), F.col("fit")))
        .filter(F.col("_m.n") > 0)
        .select(
            *FIT,
            "feature",
            F.col("_m.n").alias("n_observed"),
            F.col("_m.mx").alias("_mx"),
            F.col("_m.my").alias("_my"),
            (F.col("_m.sxx") / F.col("_m.n")).alias("_vx"),
            (F.col("_m.sxy") / F.col("_m.n")).alias("_cxy"),
        )
    )
    # Labels are a row per sample.
    inside = F.filter(_fits(folds), lambda fit: fit != F.coalesce(F.col("fold"), F.lit(0)))
    each = inside if folds else F.array(F.lit(FULL_FIT))
    labels = rows.filter(training).select("target", F.explode(each).alias("fit"), "y")
    blocks = moments.join(medians, [*FIT, "feature"])
    return filled_statistics(blocks, label_totals(labels, FIT), FIT)


def observed_cells(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    return align_target(rows, matrix)


def design_rows(
    rows: DataFrame, observed: DataFrame, selected: DataFrame, folds: int = FOLDS
) -> DataFrame:
    """``(target, fit, role, sample_id, y, features, scaled)``: features in rank
    order, missing ones at their median, and the same standardised.

    Only the selected features of a sample are gathered, so a row is as long as
    the selection.
    """
    chosen = checked_broadcast(selected.select(*FIT, "feature", "rank"))
    packed = (
        observed.select("target", "sample_id", "feature", "x")
        .join(chosen, ["target", "feature"])
        .groupBy(*FIT, "sample_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_cells"))
    )
    columns = selected.groupBy(*FIT).agg(
        F.sort_array(F.collect_list(F.struct("rank", "median", "mean", "scale"))).alias("_columns")
    )
    value = F.transform(
        "_columns",
        lambda c: F.coalesce(F.try_element_at("_cells", c["rank"]), c["median"]),
    )
    scaled = F.zip_with(
        "features", "_columns", lambda x, c: (x - c["mean"]) / c["scale"]
    )
    return (
        fit_rows(rows, folds)
        .join(packed, [*FIT, "sample_id"], "left")
        .join(checked_broadcast(columns), list(FIT))
        .withColumn("features", value)
        .withColumn("scaled", scaled)
        .select(*FIT, "role", "sample_id", "y", "features", "scaled")
    )


def first_features(design: DataFrame, k: int, columns: Sequence[str] = ("features", "scaled")) -> DataFrame:
    """The design for a smaller k: selections are nested, so it is a prefix."""
    return design.withColumns({name: F.slice(name, 1, k) for name in columns})
