"""Input views over the given tables, once as DataFrames and once as SQL.

Lineitems stand in for measurements: the customer is the sample, the region the
cohort, the brand the feature and the part the transcript.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.align import feature_matrix
from assayframe.operators.combine import collapse_transcripts
from assayframe.schema import PROTEIN, RNA
from assayframe.sources.scratch import materialize

TARGETS = ["Brand#13", "brand#7", "NOPE"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    buyers = table(spark, folder, "customer").join(
        regions, F.col("c_nationkey") == F.col("n_nationkey")
    )
    # Orders meet their buyers first, so lineitems are shuffled only once; both
    # sides grow with the data, hence a merge join whatever the estimates say.
    bought = (
        table(spark, folder, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .hint("merge")
    )
    return (
        table(spark, folder, "lineitem")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("r_name").alias("cohort"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sample_id"),
            F.lit(0).cast("long").alias("occ"),
            F.col("p_brand").alias("feature_name"),
            F.col("p_type").alias("database_id"),
            F.col("l_partkey").cast("string").alias("transcript_id"),
            "l_extendedprice",
            "l_quantity",
            "l_returnflag",
            "c_mktsegment",
        )
    )


def stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The joined sales as a table, for queries that take both assays from them."""
    return materialize(_sales(spark, folder), "sales")


def rna_cells(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    sales = _sales(spark, folder) if sales is None else sales
    keys = ["cohort", "sample_id", "occ", "feature_name", "database_id", "transcript_id"]
    cells = sales.groupBy(*keys).agg(F.avg("l_extendedprice").alias("value"))
    return cells.select(F.lit(RNA).alias("assay"), *keys, "value")


def protein_cells(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    sales = _sales(spark, folder) if sales is None else sales
    keys = ["cohort", "sample_id", "occ", "feature_name", "database_id"]
    sold = sales.filter(
        (F.col("l_returnflag") != "R") & (F.col("c_mktsegment") != "BUILDING")
    )
    cells = sold.groupBy(*keys).agg(F.avg("l_quantity").alias("value"))
    return cells.select(
        F.lit(PROTEIN).alias("assay"),
        *keys,
        F.lit(None).cast("string").alias("transcript_id"),
        "value",
    )


def all_cells(spark: SparkSession, folder: str) -> DataFrame:
    return rna_cells(spark, folder).unionByName(protein_cells(spark, folder))


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All cells, from one evaluation of the joins."""
    sales = stored_sales(spark, folder)
    return rna_cells(spark, folder, sales).unionByName(protein_cells(spark, folder, sales))


def rna_genes(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    return collapse_transcripts(rna_cells(spark, folder, sales))


def rna_matrix(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    return feature_matrix(rna_genes(spark, folder, sales))


def protein_matrix(spark: SparkSession, folder: str, sales: DataFrame | None = None) -> DataFrame:
    return feature_matrix(protein_cells(spark, folder, sales))


def embedding_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Dense matrix of embeddings with their label as ``y``."""
    return table(spark, folder, "embeddings").select(
        F.lit("label").alias("target"),
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.col("label").cast("double").alias("y"),
        F.posexplode("embedding").alias("pos", "x"),
    ).select(
        "target",
        "sample_id",
        "y",
        F.concat(F.lit("d"), F.col("pos").cast("string")).alias("feature"),
        F.col("x").cast("double").alias("x"),
    )


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of repeated runs: one row per (protein, k, iteration)."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.groupBy(
        F.col("p_type").alias("protein"),
        (F.col("l_linenumber") * 2).alias("k"),
        F.col("l_returnflag").alias("iteration"),
    ).agg(
        # Whole hundredths keep the sum exact.
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (10.0 * F.count(F.lit(1))))
        .alias("r2")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("prediction")
    )
    return table(spark, folder, "orders").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey")
    ).select(
        F.col("o_orderpriority").alias("target"),
        F.col("o_orderstatus").alias("draw"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.col("o_totalprice").alias("y"),
        "prediction",
    )


def importances(spark: SparkSession, folder: str) -> DataFrame:
    """Share of sales by feature within each cohort."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sold = _sales(spark, folder).groupBy(
        F.col("cohort").alias("target"), F.col("feature_name").alias("feature")
    ).agg(F.sum(cents).alias("amount"))
    totals = sold.groupBy("target").agg(F.sum("amount").alias("total"))
    return sold.join(totals, "target").select(
        "target", "feature", (F.col("amount") / F.col("total")).alias("importance")
    )


# The same views for the SQL twins, in order of dependence.
SQL_VIEWS = {
    "sales": """
        SELECT r_name AS cohort, 'C' || o_custkey AS sample_id, 0::BIGINT AS occ,
               p_brand AS feature_name, p_type AS database_id,
               l_partkey::VARCHAR AS transcript_id,
               l_extendedprice, l_quantity, l_returnflag, c_mktsegment
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        JOIN part ON l_partkey = p_partkey""",
    "rna_cells": """
        SELECT 'transcriptomics' AS assay, cohort, sample_id, occ, feature_name,
               database_id, transcript_id, avg(l_extendedprice) AS value
        FROM sales GROUP BY ALL""",
    "protein_cells": """
        SELECT 'proteomics' AS assay, cohort, sample_id, occ, feature_name,
               database_id, NULL::VARCHAR AS transcript_id, avg(l_quantity) AS value
        FROM sales WHERE l_returnflag <> 'R' AND c_mktsegment <> 'BUILDING'
        GROUP BY ALL""",
    "all_cells": "SELECT * FROM rna_cells UNION ALL SELECT * FROM protein_cells",
    "rna_genes": """
        SELECT cohort, sample_id, occ, feature_name, database_id, avg(value) AS value
        FROM rna_cells GROUP BY ALL""",
    "rna_matrix": """
        SELECT cohort, sample_id, occ, feature_name AS feature, avg(value) AS value
        FROM rna_genes GROUP BY ALL""",
    "protein_matrix": """
        SELECT cohort, sample_id, occ, feature_name AS feature, avg(value) AS value
        FROM protein_cells GROUP BY ALL""",
    "embedding_cells": """
        SELECT 'label' AS target, 'V' || vec_id AS sample_id, label::DOUBLE AS y,
               'd' || (pos - 1) AS feature, embedding[pos]::DOUBLE AS x
        FROM (SELECT vec_id, label, embedding,
                     unnest(generate_series(1, len(embedding))) AS pos
              FROM embeddings)""",
    "metric_rows": """
        SELECT p_type AS protein, l_linenumber * 2 AS k, l_returnflag AS iteration,
               sum(round(l_discount * 100)::BIGINT)::DOUBLE / (10.0::DOUBLE * count(*)) AS r2
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "predictions": """
        SELECT o_orderpriority AS target, o_orderstatus AS draw,
               (o_orderkey % 5)::INTEGER AS fold, o_orderkey::VARCHAR AS sample_id,
               o_totalprice AS y, prediction
        FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS prediction
                          FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey""",
    "importances": """
        SELECT target, feature, amount::DOUBLE / sum(amount) OVER (PARTITION BY target)
               AS importance
        FROM (SELECT cohort AS target, feature_name AS feature,
                     sum(round(l_extendedprice * 100)::BIGINT) AS amount
              FROM sales GROUP BY ALL)""",
    "targets": """
        SELECT * FROM (VALUES (0, 'Brand#13'), (1, 'brand#7'), (2, 'NOPE')) v(ord, target)""",
    "kept_samples": """
        SELECT m.sample_id, nf - max(n) AS n_missing, nf AS n_features
        FROM (SELECT cohort, sample_id, occ, count(value) AS n FROM rna_matrix GROUP BY ALL) m
        CROSS JOIN (SELECT count(DISTINCT feature) AS nf FROM rna_matrix)
        WHERE m.sample_id IN (SELECT sample_id FROM protein_matrix)
        GROUP BY m.sample_id, nf HAVING 5 * (nf - max(n)) <= nf""",
    "resolved": """
        SELECT t.ord, t.target,
               coalesce(max(CASE WHEN n.feature = t.target THEN n.feature END),
                        max(n.feature)) AS resolved,
               max(n.feature) IS NOT NULL AS found
        FROM targets t
        LEFT JOIN (SELECT DISTINCT feature FROM protein_matrix) n
               ON lower(n.feature) = lower(t.target)
        GROUP BY t.ord, t.target""",
    "labels_y": """
        SELECT r.target, p.sample_id, p.value AS y
        FROM protein_matrix p JOIN resolved r ON p.feature = r.resolved
        WHERE p.sample_id IN (SELECT sample_id FROM kept_samples)""",
    "placed": """
        SELECT target, sample_id, y, n, ceil(0.2::DOUBLE * n)::BIGINT AS n_test,
               row_number() OVER (PARTITION BY target
                                  ORDER BY md5(sample_id || ':42'), sample_id) AS pos
        FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM labels_y)""",
    "train": """
        SELECT target, sample_id, y, pos - n_test AS train_position,
               n - n_test AS n_train FROM placed WHERE pos > n_test""",
    "folds": """
        SELECT target, sample_id, y, train_position, n_train,
               (ntile(5) OVER (PARTITION BY target ORDER BY train_position) - 1)::INTEGER AS fold
        FROM train""",
    "observed": """
        SELECT t.target, t.sample_id, t.y, m.feature, m.value AS x
        FROM train t JOIN rna_matrix m ON t.sample_id = m.sample_id""",
    "medians": """
        SELECT target, feature, median(x) AS median, count(*) AS n_observed
        FROM observed GROUP BY ALL""",
    "filled": """
        SELECT t.target, t.sample_id, t.y, d.feature, coalesce(o.x, d.median) AS x,
               d.median, d.n_observed
        FROM train t JOIN medians d ON t.target = d.target
        LEFT JOIN observed o ON o.target = t.target AND o.sample_id = t.sample_id
                            AND o.feature = d.feature""",
    "scored": """
        SELECT target, feature, count(*) AS n, any_value(n_observed) AS n_observed,
               any_value(median) AS median, avg(x) AS mean, stddev_pop(x) AS std,
               covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r
        FROM filled GROUP BY ALL""",
    "f_scores": """
        SELECT *, coalesce(r * r / nullif(1 - r * r, 0) * (n - 2), 0) AS f_score FROM scored""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY target
                                     ORDER BY f_score DESC, feature DESC) AS rank
        FROM f_scores""",
}


def with_views(body: str) -> str:
    """Prefix a statement with the views it needs, found by name."""
    def mentions(sql: str, name: str) -> bool:
        return re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "", sql)) is not None

    needed: set[str] = set()
    todo = [body]
    while todo:
        sql = todo.pop()
        for name, definition in SQL_VIEWS.items():
            if name not in needed and mentions(sql, name):
                needed.add(name)
                todo.append(definition)
    parts = [f"{name} AS ({sql})" for name, sql in SQL_VIEWS.items() if name in needed]
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\b(.*)", body, re.DOTALL)
    joined = ", ".join(parts)
    if own and parts:
        return f"WITH{own.group(1) or ''} {joined}, {own.group(2)}"
    return f"WITH {joined} {body}" if parts else body
