"""Combine and quality-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import combine, quality
from assayframe.schema import PROTEIN, RNA
from assayframe.sources.scratch import materialize
from workload import views
from workload.registry import query

TRANSCRIPT = ("feature_name", "database_id", "transcript_id")


def rounded(name: str):
    return F.round(name, 6).alias(name)


@query(
    "scan_cells",
    """SELECT cohort, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples,
              count(DISTINCT feature_name) AS n_features, round(sum(value), 4) AS sum_value
       FROM rna_cells GROUP BY cohort""",
)
def scan_cells(spark, folder):
    return views.rna_cells(spark, folder).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("feature_name").alias("n_features"),
        F.round(F.sum("value"), 4).alias("sum_value"),
    )


@query(
    "collapse_transcripts",
    """SELECT cohort, sample_id, feature_name, database_id, round(value, 6) AS value
       FROM rna_genes""",
)
def collapse_transcripts(spark, folder):
    return views.rna_genes(spark, folder).select(
        "cohort", "sample_id", "feature_name", "database_id", rounded("value")
    )


def unnamed(genes):
    """Genes some of which have no database id."""
    return genes.withColumn("database_id", F.nullif("database_id", F.lit("PROMO")))


UNNAMED_SQL = """SELECT cohort, sample_id, occ, feature_name,
                        nullif(database_id, 'PROMO') AS database_id, value FROM rna_genes"""
ZSCORE_SQL = f"""
    WITH g AS ({UNNAMED_SQL})
    SELECT g.cohort, g.sample_id, g.feature_name, g.database_id, round(value, 6) AS value,
           round((value - mean) / std, 6) AS z
    FROM g JOIN (
        SELECT feature_name, database_id, avg(value) AS mean,
               nullif(stddev_samp(value), 0) AS std
        FROM g GROUP BY ALL) s
      ON g.feature_name = s.feature_name AND g.database_id IS NOT DISTINCT FROM s.database_id"""


@query("zscore", ZSCORE_SQL)
def zscore(spark, folder):
    genes = materialize(unnamed(views.rna_genes(spark, folder)), "genes")
    return combine.zscore(genes).select(
        "cohort", "sample_id", "feature_name", "database_id", rounded("value"), rounded("z")
    )


@query(
    "combine_cohorts",
    f"""WITH g AS ({UNNAMED_SQL}), moments AS (
           SELECT feature_name, database_id, nullif(stddev_samp(value), 0) AS std
           FROM g GROUP BY ALL)
       SELECT cohort, value_type, count(DISTINCT sample_id) AS n_rows,
              count(v) AS n_values
       FROM (SELECT cohort, sample_id, 'raw' AS value_type, value AS v FROM g
             UNION ALL
             SELECT cohort, sample_id, 'z', value / std
             FROM g JOIN moments m ON g.feature_name = m.feature_name
                                  AND g.database_id IS NOT DISTINCT FROM m.database_id)
       GROUP BY ALL""",
)
def combine_cohorts(spark, folder):
    genes = materialize(unnamed(views.rna_genes(spark, folder)), "genes", ["cohort"])
    names = [row.r_name for row in views.table(spark, folder, "region").collect()]
    tables = {name: genes.filter(F.col("cohort") == name).drop("cohort") for name in names}
    blocks = combine.value_blocks(combine.zscore(combine.combine_cohorts(tables)))
    return blocks.groupBy("cohort", "value_type").agg(
        F.countDistinct("sample_id", "occ").alias("n_rows"), F.count("value").alias("n_values")
    )


@query(
    "table_shapes",
    """SELECT assay, cohort, count(DISTINCT (sample_id, occ)) AS n_rows,
              count(DISTINCT (feature_name, database_id, coalesce(transcript_id, ''))) AS n_cols
       FROM all_cells GROUP BY ALL""",
)
def table_shapes(spark, folder):
    cells = views.all_cells(spark, folder)
    return combine.table_shapes(
        combine.sample_dimension(cells), combine.feature_dimension(cells, feature=TRANSCRIPT)
    )


QUALITY_SQL = """
    WITH s AS (SELECT DISTINCT assay, cohort, sample_id FROM all_cells),
    f AS (SELECT DISTINCT assay, cohort, feature_name, database_id,
                 coalesce(transcript_id, '') AS t FROM all_cells),
    ns AS (SELECT assay, cohort, count(*) AS n_rows FROM s GROUP BY ALL),
    nf AS (SELECT assay, cohort, count(*) AS n_cols FROM f GROUP BY ALL),
    per_s AS (SELECT assay, cohort, sample_id, 1 - count(value) / any_value(n_cols)::DOUBLE AS m
              FROM all_cells JOIN nf USING (assay, cohort) GROUP BY ALL),
    per_f AS (SELECT assay, cohort, feature_name, database_id, coalesce(transcript_id, '') AS t,
                     1 - count(value) / any_value(n_rows)::DOUBLE AS m
              FROM all_cells JOIN ns USING (assay, cohort) GROUP BY ALL),
    cc AS (SELECT assay, cohort, count(value) AS c FROM all_cells GROUP BY ALL)
    SELECT assay, cohort, n_rows, n_cols, n_rows * n_cols - c AS missing_count,
           round((n_rows * n_cols - c) / (n_rows * n_cols)::DOUBLE, 6) AS missing_fraction,
           round(sm, 6) AS per_sample_missing_mean, round(smd, 6) AS per_sample_missing_median,
           round(fm, 6) AS per_feature_missing_mean, round(fmd, 6) AS per_feature_missing_median
    FROM ns JOIN nf USING (assay, cohort) JOIN cc USING (assay, cohort)
    JOIN (SELECT assay, cohort, avg(m) AS sm, median(m) AS smd FROM per_s GROUP BY ALL)
         USING (assay, cohort)
    JOIN (SELECT assay, cohort, avg(m) AS fm, median(m) AS fmd FROM per_f GROUP BY ALL)
         USING (assay, cohort)
    WHERE cohort IN (SELECT cohort FROM ns GROUP BY cohort HAVING count(*) = 2)"""


@query("qc_table_stats", QUALITY_SQL)
def qc_table_stats(spark, folder):
    cells = materialize(
        views.stored_cells(spark, folder).withColumn(
            "transcript_id", F.coalesce("transcript_id", F.lit(""))
        ),
        "cells",
    )
    report = quality.table_quality(cells, None, None, TRANSCRIPT)
    return report.select(
        "assay",
        "cohort",
        "n_rows",
        "n_cols",
        "missing_count",
        rounded("missing_fraction"),
        rounded("per_sample_missing_mean"),
        rounded("per_sample_missing_median"),
        rounded("per_feature_missing_mean"),
        rounded("per_feature_missing_median"),
    )


@query(
    "qc_sample_overlap",
    """WITH r AS (SELECT DISTINCT cohort, sample_id FROM rna_cells),
            p AS (SELECT DISTINCT cohort, sample_id FROM protein_cells)
       SELECT cohort, count(r.sample_id) AS rna_samples, count(p.sample_id) AS protein_samples,
              count(CASE WHEN r.sample_id = p.sample_id THEN 1 END) AS overlap_samples,
              round(coalesce(count(CASE WHEN r.sample_id = p.sample_id THEN 1 END)
                             / nullif(count(r.sample_id), 0)::DOUBLE, 0), 6)
                  AS overlap_fraction_rna,
              round(coalesce(count(CASE WHEN r.sample_id = p.sample_id THEN 1 END)
                             / nullif(count(p.sample_id), 0)::DOUBLE, 0), 6)
                  AS overlap_fraction_protein
       FROM r FULL JOIN p USING (cohort, sample_id) GROUP BY cohort""",
)
def qc_sample_overlap(spark, folder):
    samples = combine.sample_dimension(views.all_cells(spark, folder))
    return quality.sample_overlap(samples, RNA, PROTEIN).select(
        "cohort",
        "rna_samples",
        "protein_samples",
        "overlap_samples",
        rounded("overlap_fraction_rna"),
        rounded("overlap_fraction_protein"),
    )


@query(
    "qc_histogram",
    """WITH rng AS (
           SELECT assay, cohort,
                  CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS a,
                  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS b
           FROM all_cells GROUP BY ALL),
       binned AS (
           SELECT assay, cohort,
                  least(floor((value - a) / (b - a) * 40), 39)::INTEGER AS bin, count(*) AS n
           FROM all_cells JOIN rng USING (assay, cohort) GROUP BY ALL)
       SELECT r.assay, r.cohort, g.bin, round(a + (b - a) / 40 * g.bin, 6) AS lo,
              round(a + (b - a) / 40 * (g.bin + 1), 6) AS hi, coalesce(n, 0) AS n
       FROM rng r CROSS JOIN (SELECT i::INTEGER AS bin FROM range(40) t(i)) g
       LEFT JOIN binned k ON k.assay = r.assay AND k.cohort = r.cohort AND k.bin = g.bin""",
)
def qc_histogram(spark, folder):
    cells = materialize(views.stored_cells(spark, folder), "cells")
    return quality.value_histogram(cells).select(
        "assay", "cohort", "bin", rounded("lo"), rounded("hi"), "n"
    )


@query(
    "qc_sample_values",
    """WITH m AS (SELECT 'transcriptomics' AS assay, * FROM rna_matrix),
       s AS (SELECT assay, cohort, sample_id, occ,
                    row_number() OVER (PARTITION BY assay, cohort
                        ORDER BY md5(sample_id || '|' || occ || ':0'), sample_id, occ) AS rk
             FROM (SELECT DISTINCT assay, cohort, sample_id, occ FROM m)),
       f AS (SELECT assay, cohort, feature,
                    row_number() OVER (PARTITION BY assay, cohort
                        ORDER BY md5(feature || ':0'), feature) AS rk
             FROM (SELECT DISTINCT assay, cohort, feature FROM m))
       SELECT m.cohort, m.sample_id, m.feature, round(value, 6) AS value
       FROM m JOIN s USING (assay, cohort, sample_id, occ) JOIN f USING (assay, cohort, feature)
       WHERE s.rk <= 200 AND f.rk <= 2000""",
)
def qc_sample_values(spark, folder):
    matrix = materialize(views.rna_matrix(spark, folder).withColumn("assay", F.lit(RNA)), "rna")
    sampled = quality.sample_values(
        matrix,
        combine.sample_dimension(matrix),
        combine.feature_dimension(matrix, feature=["feature"]),
        ["feature"],
    )
    return sampled.select("cohort", "sample_id", "feature", rounded("value"))
