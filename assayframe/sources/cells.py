"""Cells on disk: parquet by assay and cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions import null_if_nan, split_list
from assayframe.operators.joins import checked_broadcast
from assayframe.schema import CELLS

# Fixed layout of a raw folder: one folder per cohort, and per assay one file or a
# folder of that name with part files.
RAW_FILE = r"/([^/]+)/(transcriptomics|proteomics)\.parquet(?:/[^/]+\.parquet)?$"
# Rows of a part file are numbered from its place among the files times this.
ROWS_PER_FILE = 1 << 40


def conform(cells: DataFrame) -> DataFrame:
    """Bring a frame to the cell schema: absent columns become NULL, NaN and
    NULL values are dropped."""
    shaped = []
    for field in CELLS.fields:
        if field.name == "value":
            shaped.append(null_if_nan(F.col("value")).alias("value"))
        elif field.name in cells.columns:
            shaped.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            shaped.append(F.lit(None).cast(field.dataType).alias(field.name))
    return cells.select(*shaped).filter(F.col("value").isNotNull())


def write_cells(cells: DataFrame, path: str, partition_by: Sequence[str] = ("assay", "cohort")) -> None:
    """Write cells partitioned by table and clustered by feature.

    Rebalancing splits a large cohort over many files without sampling the cells
    first, which would read their source twice; in a file they are in order, so
    feature filters skip row groups. Measurements are stored in single precision.
    An earlier table at ``path`` is replaced.
    """
    order = [*partition_by, "feature_name", "sample_id"]
    single = {name: F.col(name).cast("float") for name in ("value", "z") if name in cells.columns}
    (
        cells.withColumns(single)
        .hint("rebalance", *partition_by)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Scan cells; filters on assay and cohort prune folders, filters on the
    feature prune row groups."""
    return spark.read.parquet(path)


def cohort_tables(spark: SparkSession, raw_root: str) -> DataFrame:
    """``(cohort, assay, path)`` of every raw table below a folder; the folder
    is listed without reading any file."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(raw_root)
        .select("path")
    )
    found = listed.select(
        F.regexp_extract("path", RAW_FILE, 1).alias("cohort"),
        F.regexp_extract("path", RAW_FILE, 2).alias("assay"),
        "path",
    ).filter(F.col("cohort") != "")
    if found.isEmpty():
        raise RuntimeError(f"no cohort tables below {raw_root}")
    return found


def with_table_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Make ``occ``, the row number in a file, the one in its table: part files follow
    each other by name. ``files`` are those of :func:`cohort_tables`."""
    order = Window.partitionBy("cohort", "assay").orderBy("path")
    places = files.select("path", (F.row_number().over(order) - 1).cast("long").alias("_file"))
    placed = rows.join(checked_broadcast(places), "path")
    return placed.withColumn("occ", F.col("occ") + F.col("_file") * ROWS_PER_FILE).drop("_file")


def cohort_inventory(tables: DataFrame, first: str, second: str, only: str = "") -> DataFrame:
    """Cohorts, lowercased, and which assays they have; ``only`` is a comma list
    of cohorts to keep, in any case."""
    named = tables.filter(F.coalesce("cohort", F.lit("")) != "").withColumn(
        "cohort", F.lower("cohort")
    )
    if only.strip(" ,"):
        named = named.filter(F.array_contains(split_list(F.lit(only.lower())), F.col("cohort")))
    return named.groupBy("cohort").agg(
        F.coalesce(F.max(F.col("assay") == first), F.lit(False)).alias("has_rna"),
        F.coalesce(F.max(F.col("assay") == second), F.lit(False)).alias("has_protein"),
    )
