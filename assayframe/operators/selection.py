"""Imputation, scaling and univariate feature ranking without densifying.

A missing cell is later filled with the median of its feature. Its effect on
means, variances and correlations depends on the median and on counts only, so
each statistic merges two blocks: the observed cells, aggregated as they are,
and the filled ones, which all sit at the median.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import f_statistic, safe_divide
from assayframe.operators.joins import checked_broadcast
from assayframe.operators.quantiles import exact_median
from assayframe.operators.ranking import top_per_group


def label_totals(labels: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Row count, mean and variance of ``y`` per fit."""
    return labels.groupBy(*keys).agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean_y"),
        F.var_pop("y").alias("var_y"),
    )


def feature_statistics(
    observed: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = ("target",),
) -> DataFrame:
    """Per fit and feature: median, mean, deviation, scale and F score of the
    median-filled training column.

    ``observed`` holds the training cells ``(keys, feature, x, y)``, ``labels``
    one row ``(keys, y)`` per training sample. Features without a training value
    do not appear. The cells are read twice, by the two passes of the median;
    nothing is pivoted.
    """
    by_feature = [*keys, "feature"]
    moments = {
        "n_observed": F.count("x"),
        "_mx": F.avg("x"),
        "_my": F.avg("y"),
        "_vx": F.var_pop("x"),
        "_cxy": F.covar_pop("x", "y"),
    }
    blocks = exact_median(observed, by_feature, "x", alongside=moments)
    return filled_statistics(blocks, label_totals(labels, keys), keys)


def filled_statistics(
    blocks: DataFrame, totals: DataFrame, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Statistics of the median-filled columns from the moments of their observed
    cells (``n_observed, _mx, _my, _vx, _cxy, median``) and the totals of the labels."""
    by_feature = [*keys, "feature"]
    n, seen = F.col("n"), F.col("n_observed")
    filled = n - seen
    # Mean of y over the filled rows, and the shift between the two blocks.
    my_filled = safe_divide(n * F.col("mean_y") - seen * F.col("_my"), filled)
    shift_x = F.col("_mx") - F.col("median")
    shift_y = F.coalesce(F.col("_my") - my_filled, F.lit(0.0))
    weight = safe_divide(seen * filled, n)
    sxx = seen * F.col("_vx") + weight * shift_x * shift_x
    sxy = seen * F.col("_cxy") + weight * shift_x * shift_y
    variance = safe_divide(F.col("_sxx"), n)
    r = safe_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * n * F.col("var_y")))
    return (
        blocks.join(totals, list(keys))
        .withColumns({"_sxx": sxx, "_sxy": sxy})
        .withColumns(
            {
                "n_imputed": filled,
                "mean": F.col("median") + safe_divide(seen, n) * shift_x,
                "std": F.sqrt(variance),
                "r": r,
            }
        )
        .withColumns(
            {
                "scale": F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")),
                "f_score": f_statistic(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)), n),
            }
        )
        .select(
            *by_feature, "n", "n_observed", "n_imputed", "median", "mean", "std", "scale",
            "mean_y", "r", "f_score",
        )
    )


def rank_features(
    statistics: DataFrame, k: int | None, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Rank by F score, of equal scores the later name first, and keep ``k``.
    Below two there is no selection and every feature stays."""
    order = [F.col("f_score").desc(), F.col("feature").desc()]
    limit = k if k is not None and k >= 2 else 2**31 - 1
    return top_per_group(statistics, keys, order, limit)


def sweep_selection(
    statistics: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Selections for many k from a single ranking: k is only a cut-off."""
    if not ks:
        raise ValueError("no k values given")
    largest = max(ks) if min(ks) >= 2 else None
    ranked = rank_features(statistics, largest, keys)
    sizes = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    reached = F.filter(sizes, lambda k: (k < 2) | (F.col("rank") <= k))
    return ranked.withColumn("k", F.explode(reached))


def pending_runs(targets: DataFrame, ks: Sequence[int], done: DataFrame) -> DataFrame:
    """``(target, k)`` of a sweep that have no metrics yet."""
    sizes = F.array(*[F.lit(int(k)) for k in ks])
    planned = targets.select("target", F.explode(sizes).alias("k"))
    return planned.join(done.select("target", "k"), ["target", "k"], "left_anti")


def scale_cells(observed: DataFrame, statistics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standardise observed cells with the statistics of their fit. The cells stay
    where they are while the statistics fit the broadcast bounds."""
    side = checked_broadcast(statistics.select(*keys, "feature", "mean", "scale"))
    z = (F.col("x") - F.col("mean")) / F.col("scale")
    return observed.join(side, [*keys, "feature"]).withColumn("z", z).drop("mean", "scale")
