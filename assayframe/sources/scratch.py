"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``. Only a local
    session may do without, and gets a temporary one."""
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="assayframe-")
    return _local_folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/assayframe-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Frames that still read
    one of them fail afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(
    frame: DataFrame, name: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write a frame that several jobs read, and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning, filter
    push-down and partition pruning for the readers.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    # One file per partition value where it fits, a large one split.
    laid_out = frame.hint("rebalance", *partition_by) if partition_by else frame
    laid_out.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    # The given schema keeps partition columns from being re-typed.
    return spark.read.schema(frame.schema).parquet(path).select(*frame.columns)
