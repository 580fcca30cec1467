"""Raw cohort files to combined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import clean_sample_id, split_list
from assayframe.operators import combine
from assayframe.schema import PROTEIN, RNA
from assayframe.sources.cells import (
    RAW_FILE,
    cohort_tables,
    conform,
    with_table_rows,
    write_cells,
)
from assayframe.sources.matrices import read_wide, with_header
from assayframe.sources.sinks import read_summary, upsert_summary, write_summary


def raw_cells(spark: SparkSession, raw_root: str, index: str | None = None) -> DataFrame:
    """Cells of all raw cohort files, tagged with cohort and assay by their
    path."""
    files = cohort_tables(spark, raw_root)
    wide = with_table_rows(read_wide(spark, files, index), files)
    tagged = wide.withColumns(
        {
            "cohort": F.regexp_extract("path", RAW_FILE, 1),
            "assay": F.regexp_extract("path", RAW_FILE, 2),
            "sample_id": clean_sample_id(F.col("sample_id")),
        }
    )
    return conform(with_header(tagged))


RAW_SUMMARY = "cohort string, assay string, n_rows long, n_cols long, path string"


def summarise_raw(
    spark: SparkSession, raw_root: str, path: str, only: str = "", index: str | None = None
) -> DataFrame:
    """Summary of the raw tables at ``path``: rows and columns of each. Entries of the
    cohorts looked at now (``only`` lists some) are replaced, those of others stay."""
    cells = raw_cells(spark, raw_root, index)
    if only.strip(" ,"):
        cells = cells.filter(F.array_contains(split_list(F.lit(only)), F.col("cohort")))
    table = ["cohort", "assay"]
    rows = cells.groupBy(*table).agg(F.countDistinct("sample_id", "occ").alias("n_rows"))
    columns = combine.feature_dimension(cells, table, [*combine.FEATURE, "transcript_id"])
    shapes = rows.join(columns.groupBy(*table).agg(F.count(F.lit(1)).alias("n_cols")), table)
    place = F.concat(F.lit(f"{raw_root.rstrip('/')}/"), "cohort", F.lit("/"), "assay", F.lit(".parquet"))
    new = shapes.select(*table, "n_rows", "n_cols", place.alias("path"))
    schema = spark.createDataFrame([], RAW_SUMMARY).schema
    write_summary(upsert_summary(read_summary(spark, path, schema), new, ["cohort"]), path)
    return read_summary(spark, path, schema)


def gene_cells(cells: DataFrame) -> DataFrame:
    """RNA cells at gene level: transcript tables collapsed, others as they are."""
    rna = cells.filter(F.col("assay") == RNA)
    columns = [*combine.OCCURRENCE, *combine.FEATURE, "value"]
    collapsed = combine.collapse_transcripts(rna.filter(F.col("transcript_id").isNotNull()))
    return (
        rna.filter(F.col("transcript_id").isNull())
        .select(*columns)
        .unionByName(collapsed.select(*columns))
    )


def build_tables(
    spark: SparkSession, raw_root: str, out: str, index: str | None = None
) -> dict[str, DataFrame]:
    """Write ``all_rna`` (raw and z side by side), ``all_protein`` and their
    shapes below ``out``."""
    cells_path = f"{out}/cells"
    write_cells(raw_cells(spark, raw_root, index), cells_path)
    cells = spark.read.parquet(cells_path)
    genes_path, rna_path = f"{out}/rna_genes", f"{out}/all_rna"
    # The genes are read twice, for the moments and for the scores.
    gene_cells(cells).write.mode("overwrite").partitionBy("cohort").parquet(genes_path)
    genes = spark.read.parquet(genes_path)
    write_cells(combine.zscore(genes), rna_path, ["cohort"])
    protein_path = f"{out}/all_protein"
    write_cells(cells.filter(F.col("assay") == PROTEIN).drop("assay"), protein_path, ["cohort"])
    tables = {
        "all_rna": spark.read.parquet(rna_path),
        "all_protein": spark.read.parquet(protein_path),
    }
    shapes = None
    for name, path in (("all_rna", rna_path), ("all_protein", protein_path)):
        table = tables[name].withColumn("table", F.lit(name))
        shape = combine.table_shapes(
            combine.sample_dimension(table, ["table"]),
            combine.feature_dimension(table, ["table"]),
            ["table"],
        ).withColumn("path", F.lit(path))
        shapes = shape if shapes is None else shapes.unionByName(shape)
    write_summary(shapes, f"{out}/processed_summary.json")
    return tables
