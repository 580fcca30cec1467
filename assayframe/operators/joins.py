"""Joins against sides that are usually small, and first-row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.sources.scratch import materialize

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Rows made by the driver, if they are as few, need no measuring.
KNOWN_SMALL_BYTES = 1024 * 1024


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        each = F.transform(column, lambda x: _bytes_of(x, kind.elementType))
        whole = F.aggregate(each, F.lit(8).cast("long"), lambda total, x: total + x)
        return F.coalesce(whole, F.lit(8).cast("long"))
    if isinstance(kind, T.StructType):
        total = F.lit(0).cast("long")
        for field in kind.fields:
            total = total + _bytes_of(column[field.name], field.dataType)
        return total
    return F.lit(8).cast("long")


def checked_broadcast(
    side: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Store ``side``, measure it, and mark it for broadcast only if it fits the bounds.

    Meant for per-feature or per-table statistics that are joined back to all
    cells: a broadcast leaves the cells where they are. Nothing but two numbers reaches
    the driver before the size is known. A larger side is returned as it is stored,
    and the join shuffles, with adaptive execution splitting hot keys.
    """
    plan = side._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    own_rows = all(leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size()))
    # No row is estimated at less than eight bytes.
    if own_rows and int(str(plan.stats().sizeInBytes())) <= min(KNOWN_SMALL_BYTES, max_bytes, 8 * max_rows):
        return F.broadcast(side)
    stored = materialize(side, "side")
    width = F.lit(0).cast("long")
    for field in stored.schema.fields:
        width = width + _bytes_of(F.col(field.name), field.dataType)
    rows, size = stored.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(stored) if rows <= max_rows and (size or 0) <= max_bytes else stored


def first_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Keep the first row of every key. The rank limit is applied before the
    shuffle too, so a hot key sends one row per input partition."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_first", F.row_number().over(window))
        .filter(F.col("_first") == 1)
        .drop("_first")
    )
