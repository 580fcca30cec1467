"""Positions within a group that never need the group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced_position(
    rows: DataFrame,
    group: Sequence[str],
    slice_column: str,
    order: Sequence[Column | str],
    position: str = "position",
    total: str = "group_rows",
) -> DataFrame:
    """Exact 1-based row number per ``group``, computed slice by slice.

    ``slice_column`` must cut each group into ordered pieces: every row of a
    lower slice comes before every row of a higher one. Rows are numbered inside
    their slice and shifted by the number of rows in lower slices, so only
    slice sizes are ever gathered per group. Also adds the group size as
    ``total``.
    """
    keys = [*group, slice_column]
    inside = Window.partitionBy(*keys).orderBy(*order)
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *keys,
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
            F.sum("_size").over(per_group).alias(total),
        )
    )
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(position, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def seeded_digest(label: Column, seed: int | str) -> Column:
    """Order key of a seeded shuffle, the same in every engine."""
    return F.md5(F.concat_ws(":", label.cast("string"), F.lit(str(seed))))


def seeded_number(label: Column, seed: int | str) -> Column:
    """A whole number below 2 ** 28 from the same digest."""
    return F.conv(F.substring(seeded_digest(label, seed), 1, 7), 16, 10).cast("long")


def seeded_position(
    rows: DataFrame,
    group: Sequence[str],
    label: str,
    seed: int | str,
    position: str = "position",
    total: str = "group_rows",
    slice_digits: int = 3,
) -> DataFrame:
    """Position of each row in a seeded shuffle of its group.

    Slices are the leading hex digits of the digest, hence even: a group of
    any size is spread over ``16 ** slice_digits`` pieces.
    """
    keyed = rows.withColumn("_digest", seeded_digest(F.col(label), seed)).withColumn(
        "_slice", F.substring("_digest", 1, slice_digits)
    )
    placed = sliced_position(keyed, group, "_slice", ["_digest", label], position, total)
    return placed.drop("_digest", "_slice")


def top_per_group(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """Best ``k`` rows per group; each input partition forwards at most ``k``."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window).cast("long")).filter(
        F.col(rank) <= k
    )
