"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SESSION_CONF = {
    # Runtime re-planning: coalesced partitions, hot join keys split, and a
    # shuffle join turned into a broadcast one once the small side is measured.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Top-k selections keep up to this many rows per group before the shuffle;
    # the default of 1000 is below the usual 2000 selected features.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
    # Quantile sketches stay hash based for some more groups than the default of
    # 128; a sketch of a large group takes about half a megabyte.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "512",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`SESSION_CONF` to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder
