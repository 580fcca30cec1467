"""Null-safe arithmetic and regression statistics as expressions.

Everything divides through ``try_divide``: under ANSI rules a plain division
or ``corr`` raises on a zero denominator, also inside ``CASE WHEN``.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(value: Column) -> Column:
    """Missing is NULL throughout: aggregates skip NULL but propagate NaN."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(safe_divide(numerator, denominator), F.lit(0.0))


def elapsed_seconds(since: Column, now: Column) -> Column:
    """Seconds between two times in seconds, to a tenth."""
    return F.round(now - since, 1)


def r_squared(y: Column, prediction: Column) -> Column:
    """Aggregate 1 - SSE/SST. A constant ``y`` scores 1 when it is predicted
    exactly and 0 otherwise; fewer than two rows have no score."""
    n = F.count(y)
    sse = F.sum((y - prediction) * (y - prediction))
    sst = F.var_pop(y) * n
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    score = F.when(sst == 0, constant).otherwise(F.lit(1.0) - F.try_divide(sse, sst))
    return F.when(n >= 2, score)


def pearson(y: Column, prediction: Column) -> Column:
    """Aggregate correlation; NULL when a side is constant."""
    return F.try_divide(
        F.covar_pop(y, prediction), F.stddev_pop(y) * F.stddev_pop(prediction)
    )


def f_statistic(r2: Column, n: Column) -> Column:
    """F score of a squared correlation over ``n`` rows. Undefined (a constant
    side, or no degrees of freedom) is 0; a perfect fit is the largest double."""
    perfect = F.when(n > 2, F.lit(sys.float_info.max)).otherwise(F.lit(0.0))
    score = F.try_divide(r2, F.lit(1.0) - r2) * (n - 2)
    return F.when(r2 >= 1, perfect).otherwise(F.coalesce(score, F.lit(0.0)))
