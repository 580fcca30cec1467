"""Result files: CSV records, JSON summaries and run events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.schema import RUN_EVENTS
from assayframe.sources.scratch import materialize


def write_csv(
    records: DataFrame, path: str, order: Sequence[str] = (), columns: Sequence[str] | None = None
) -> None:
    """CSV with a header, in place of an earlier one. Report tables hold a row per
    target or so, and go to one file, in order if one is given. They are brought
    together after they were made: what makes them keeps its tasks."""
    together = records.repartition(1)
    laid_out = together.sortWithinPartitions(*order) if order else together
    chosen = laid_out.select(*(columns or records.columns))
    chosen.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}.next"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def read_summary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Earlier summary; an absent or broken one counts as empty. One that was written in
    full but not yet put in the place of the one before is found where that is gone."""
    system, target = _file_system(spark, path)
    written = _file_system(spark, f"{_staged(path)}/_SUCCESS")[1]
    found = _staged(path) if not system.exists(target) and system.exists(written) else path
    try:
        read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)
        read.isEmpty()
        return read
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upsert_summary(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the entries computed now and keep the rest."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return new.unionByName(kept)


def write_summary(summary: DataFrame, path: str) -> None:
    """Replace the summary at ``path``, which ``summary`` may be built from.

    The new one is written beside it and takes its place when it is complete: a run that
    fails on the way leaves the old one or the new one, see :func:`read_summary`.
    """
    settled = materialize(summary, "summary")
    spark = settled.sparkSession
    settled.write.mode("overwrite").option("ignoreNullFields", "false").json(_staged(path))
    system, target = _file_system(spark, path)
    system.delete(target, True)
    if not system.rename(_file_system(spark, _staged(path))[1], target):
        raise OSError(f"cannot put {_staged(path)} in place of {path}")


def summary_documents(summary: DataFrame, entry: str, keys: Sequence[str]) -> DataFrame:
    """Nest flat rows: one JSON document per ``entry`` with a member per key."""
    fields = [name for name in summary.columns if name not in (entry, *keys)]
    member = F.struct(F.concat_ws("/", *keys).alias("key"), F.struct(*fields).alias("value"))
    nested = F.map_from_entries(F.sort_array(F.collect_list(member)))
    return summary.groupBy(entry).agg(F.to_json(nested).alias("document"))


def append_events(events: DataFrame, path: str) -> None:
    """Add run events; earlier ones stay."""
    events.select(*RUN_EVENTS.fieldNames()).write.mode("append").parquet(path)


def current_stage(events: DataFrame) -> DataFrame:
    """Latest event of each run."""
    latest = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return (
        events.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    )
