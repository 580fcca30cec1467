"""Reports on predictions, metrics and importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions import pearson, r_squared
from assayframe.operators.joins import first_per_key
from assayframe.operators.ranking import top_per_group

# Compared pairs, report length, charted range and knee rule.
GAP_PAIRS = (("KRAS", "GAPDH"), ("TP53", "GAPDH"))
TOP_FEATURES = 50
ELBOW_RANGE = (2, 20)
KNEE_GAIN = 0.01
KNEE_MIN_POINTS = 4


def regression_metrics(
    predictions: DataFrame,
    keys: Sequence[str] = ("target",),
    y: str = "y",
    prediction: str = "prediction",
) -> DataFrame:
    """R², mean absolute error and Pearson correlation per key."""
    observed, predicted = F.col(y), F.col(prediction)
    return predictions.groupBy(*keys).agg(
        F.count(observed).alias("n"),
        r_squared(observed, predicted).alias("r2"),
        F.avg(F.abs(observed - predicted)).alias("mae"),
        pearson(observed, predicted).alias("pearson"),
    )


def prediction_range(
    predictions: DataFrame, keys: Sequence[str] = ("target",), y: str = "y",
    prediction: str = "prediction",
) -> DataFrame:
    """Ends of the identity line: joint range of observed and predicted."""
    return predictions.groupBy(*keys).agg(
        F.least(F.min(y), F.min(prediction)).alias("lo"),
        F.greatest(F.max(y), F.max(prediction)).alias("hi"),
    )


def mean_scores(by_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean of the fold scores; without one of them there is no mean."""
    complete = F.count("r2") == F.count(F.lit(1))
    return by_fold.groupBy(*keys).agg(F.when(complete, F.avg("r2")).alias("mean_r2"))


def cv_scores(
    predictions: DataFrame,
    keys: Sequence[str] = ("target",),
    candidate: str = "draw",
    fold: str = "fold",
) -> DataFrame:
    """Unweighted mean of fold R² per candidate; the best one per key, the first
    on ties, is marked."""
    by_fold = regression_metrics(predictions, [*keys, candidate, fold])
    scores = mean_scores(by_fold, [*keys, candidate])
    order = [F.col("mean_r2").desc_nulls_last(), F.col(candidate)]
    window = Window.partitionBy(*keys).orderBy(*order)
    return scores.withColumn("is_best", F.row_number().over(window) == 1)


def top_features(
    importances: DataFrame, keys: Sequence[str] = ("target",), n: int = TOP_FEATURES
) -> DataFrame:
    return top_per_group(importances, keys, [F.col("importance").desc(), "feature"], n)


def target_in_top(top: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Whether the target is among its own top features, as spelled."""
    return top.groupBy(*keys).agg(
        F.coalesce(F.max(F.col("feature") == F.col("target")), F.lit(False)).alias("in_top50")
    )


def accuracy_gap(
    metrics: DataFrame,
    order: Column | str,
    pairs: Sequence[tuple[str, str]] = GAP_PAIRS,
    metric: str = "rf_r2",
) -> DataFrame:
    """Difference of a metric between driver and control of each pair, from the
    first row of either; pairs without both values are left out."""
    spark = metrics.sparkSession
    listed = F.broadcast(spark.createDataFrame(list(pairs), "driver string, control string"))
    firsts = first_per_key(metrics, ["target"], [order]).select("target", F.col(metric).alias("_m"))
    firsts = firsts.filter(F.col("_m").isNotNull() & ~F.isnan("_m"))
    driver = firsts.select(F.col("target").alias("driver"), F.col("_m").alias("_d"))
    control = firsts.select(F.col("target").alias("control"), F.col("_m").alias("_c"))
    return (
        driver.join(listed, "driver")
        .join(control, "control")
        .select("driver", "control", (F.col("_d") - F.col("_c")).alias(f"accuracy_gap_{metric}"))
    )


def metric_summary(metrics: DataFrame, metric: str = "r2") -> DataFrame:
    """Mean and sample deviation of a metric per protein and k."""
    kept = metrics.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    return kept.groupBy("protein", "k").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")
    )


def elbow_table(
    metrics: DataFrame, metric: str = "r2", k_range: tuple[int, int] = ELBOW_RANGE
) -> DataFrame:
    """Data of the elbow charts, all proteins in one table."""
    low, high = k_range
    # The range is on a grouping key, so it reaches the scan.
    return metric_summary(metrics, metric).filter(F.col("k").between(low, high)).select(
        "protein",
        "k",
        F.log10("k").alias("log10_k"),
        "mean",
        "std",
        F.coalesce("std", F.lit(0.0)).alias("std_or_zero"),
    )


def detect_knee(
    summary: DataFrame,
    score: str = "mean",
    gain: float = KNEE_GAIN,
    min_points: int = KNEE_MIN_POINTS,
) -> DataFrame:
    """First k per protein from which three successive gains stay below
    ``gain``; NULL without one. Groups hold one row per k."""
    by_k = Window.partitionBy("protein").orderBy("k")
    clean = F.when(~F.isnan(score), F.col(score))
    gains = summary.withColumn("_gain", clean - F.lag(clean).over(by_k))
    flat = F.lit(True)
    for ahead in range(3):
        step = F.col("_gain") if ahead == 0 else F.lead("_gain", ahead).over(by_k)
        flat = flat & F.coalesce(step < gain, F.lit(False))
    return (
        gains.withColumn("_flat", flat)
        .groupBy("protein")
        .agg(
            F.when(
                F.count(F.lit(1)) >= min_points, F.min(F.when(F.col("_flat"), F.col("k")))
            ).alias("knee_k")
        )
    )
