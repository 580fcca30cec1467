"""Source, sink, identifier and catalog queries."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from assayframe.functions import (
    camel_case,
    clean_feature_id,
    clean_sample_id,
    k_from_run_dir,
    split_list,
)
from assayframe.operators import combine, search
from assayframe.plans import combining
from assayframe.schema import PROTEIN, RNA
from assayframe.sources import catalog, cells, matrices, metrics, sinks
from assayframe.sources.scratch import materialize, scratch_path
from workload import views
from workload.registry import query
from workload.tables import rounded

@query(
    "cells_roundtrip",
    """SELECT assay, cohort, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples,
              round(min(value::FLOAT)::DOUBLE, 3) AS least, round(max(value::FLOAT)::DOUBLE, 3) AS greatest
       FROM all_cells GROUP BY ALL""",
)
def cells_roundtrip(spark, folder):
    path = scratch_path(spark, "cells")
    cells.write_cells(cells.conform(views.all_cells(spark, folder)), path)
    return cells.read_cells(spark, path).groupBy("assay", "cohort").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.round(F.min("value").cast("double"), 3).alias("least"),
        F.round(F.max("value").cast("double"), 3).alias("greatest"),
    )


@query(
    "cohort_inventory",
    """SELECT lower(cohort) AS cohort, coalesce(bool_or(assay = 'transcriptomics'), false) AS has_rna,
              coalesce(bool_or(assay = 'proteomics'), false) AS has_protein
       FROM all_cells WHERE cohort IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1""",
)
def cohort_inventory(spark, folder):
    tables = views.all_cells(spark, folder).select("cohort", "assay").distinct()
    return cells.cohort_inventory(tables, RNA, PROTEIN, only="Asia, EUROPE,africa, NOWHERE")


def events_wide(spark, folder):
    """A column for every type there is."""
    events = views.table(spark, folder, "events")
    types = events.select("event_type").distinct().orderBy("event_type").collect()
    return matrices.pivot_mean(events, "user_id", "event_type", [row.event_type for row in types])


EVENTS_LONG = """SELECT user_id::VARCHAR AS sample_id, event_type AS feature,
                        round(avg(value), 6) AS value
                 FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL"""


@query("unpivot_wide", EVENTS_LONG)
def unpivot_wide(spark, folder):
    long = matrices.unpivot_matrix(events_wide(spark, folder), "user_id")
    return long.select("sample_id", "feature", rounded("value"))


@query("wide_scan", EVENTS_LONG)
def wide_scan(spark, folder):
    """The same matrix through a file and the reader for very wide files."""
    path = scratch_path(spark, "wide")
    events_wide(spark, folder).write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    wide = matrices.read_wide(spark, files, index="user_id", columns_per_task=2)
    return wide.select("sample_id", F.col("label").alias("feature"), rounded("value"))


@query(
    "pivot_mean",
    """SELECT * FROM (PIVOT (SELECT user_id, event_type, value FROM events) ON event_type
                      USING round(avg(value), 6) GROUP BY user_id)""",
)
def pivot_mean(spark, folder):
    wide = events_wide(spark, folder)
    return wide.select("user_id", *[rounded(n) for n in wide.columns if n != "user_id"])


@query(
    "long_alias_scan",
    """SELECT user_id::VARCHAR AS sample_id, event_type AS feature, round(avg(value), 6) AS value
       FROM events GROUP BY ALL""",
)
def long_alias_scan(spark, folder):
    foreign = views.table(spark, folder, "events").select(
        F.col("user_id").alias("Patient_ID"),
        F.col("event_type").alias("Gene"),
        F.col("value").alias("Abundance"),
    )
    return matrices.read_long(foreign).select("sample_id", "feature", rounded("value"))


@query(
    "load_matrix",
    """SELECT user_id::VARCHAR AS sample_id, event_type AS feature, round(avg(value), 6) AS value
       FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL""",
)
def load_matrix(spark, folder):
    """A wide table whose orientation is told by its row axis."""
    wide = events_wide(spark, folder).withColumnRenamed("user_id", "patient_id")
    return matrices.load_matrix(wide, "patient_id").select(
        "sample_id", "feature", rounded("value")
    )


@query(
    "header_parse",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'raw' END AS value_type,
              p_name AS feature_name, CASE WHEN p_size % 3 = 1 THEN p_brand END AS transcript_id,
              p_type AS database_id
       FROM part""",
)
def header_parse(spark, folder):
    """Column labels of two and three levels back to their parts."""
    kind = F.col("p_size") % 3
    levels = (
        F.when(kind == 0, F.array(F.lit("raw"), "p_name", "p_type"))
        .when(kind == 1, F.array("p_name", "p_brand", "p_type"))
        .otherwise(F.array("p_name", "p_type"))
    )
    label = F.concat(F.lit("('"), F.array_join(levels, "', '"), F.lit("')"))
    labels = views.table(spark, folder, "part").select("p_partkey", label.alias("label"))
    return matrices.with_header(labels).select(
        "p_partkey", "value_type", "feature_name", "transcript_id", "database_id"
    )


@query(
    "current_stage",
    """SELECT run_id, stage FROM (
           SELECT user_id::VARCHAR AS run_id, event_type AS stage,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
           FROM events) WHERE rn = 1""",
)
def current_stage(spark, folder):
    log = views.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stage"),
    )
    return sinks.current_stage(log).select("run_id", "stage")


def recorded_runs(spark, folder):
    """Metrics of one run per k, as a finished sweep leaves them."""
    return views.metric_rows(spark, folder).select(
        F.concat(F.lit("outputs_k"), F.col("k").cast("string")).alias("run_dir"),
        F.col("protein").alias("target"),
        F.col("r2").alias("rf_r2"),
        F.lit(None).cast("double").alias("rf_mae"),
        "k",
    )


@query(
    "metrics_files",
    """SELECT protein, k, count(*) AS n, round(sum(r2), 6) AS sum_r2, 1::BIGINT AS first_row,
              sum(count(*)) OVER (PARTITION BY k)::BIGINT AS last_row,
              sum(count(*)) OVER (PARTITION BY k)::BIGINT AS numbered
       FROM metric_rows GROUP BY protein, k""",
)
def metrics_files(spark, folder):
    """Metrics written as files, one run folder per k, and read back."""
    root = scratch_path(spark, "runs")
    runs = materialize(recorded_runs(spark, folder), "runs", ["k"])
    for k in [row.k for row in runs.select("k").distinct().collect()]:
        own = runs.filter(F.col("k") == k).select("target", "rf_r2", "rf_mae")
        sinks.write_csv(own, f"{root}/outputs_k{k}/metrics.csv")
    found = metrics.read_metrics(spark, [f"{root}/outputs*"])
    # Rows are numbered through the file of a run.
    ordinals = found.groupBy("k").agg(
        F.min("iteration").alias("first_row"),
        F.max("iteration").alias("last_row"),
        F.countDistinct("iteration").alias("numbered"),
    )
    sums = found.groupBy("protein", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("r2"), 6).alias("sum_r2")
    )
    return sums.join(ordinals, "k")


@query(
    "standardize_ids",
    r"""SELECT p_partkey, raw_id, sample_id,
              coalesce(regexp_replace(trim(raw_id, E' \t\n'),
                                      '^(ENS[GPT][0-9]+)\.([0-9]+)$', '\1', 'i'), '') AS clean_id,
              trim(sample_id, E' \t\n') AS clean_sample
       FROM (SELECT p_partkey, ' C' || p_size || E'\t' AS sample_id,
                    CASE p_size % 6
                        WHEN 0 THEN ' ENSG' || p_partkey || '.' || p_size
                        WHEN 1 THEN 'ensp' || p_partkey || '.' || p_size || E'\t'
                        WHEN 2 THEN 'ENST' || p_partkey || '.' || p_size || E'\n'
                        WHEN 3 THEN 'ENSX' || p_partkey || '.' || p_size
                        WHEN 4 THEN ' ' || p_name || ' ' END AS raw_id
             FROM part)""",
)
def standardize_ids(spark, folder):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kind = F.col("p_size") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit(" ENSG"), key, F.lit("."), size))
        .when(kind == 1, F.concat(F.lit("ensp"), key, F.lit("."), size, F.lit("\t")))
        .when(kind == 2, F.concat(F.lit("ENST"), key, F.lit("."), size, F.lit("\n")))
        .when(kind == 3, F.concat(F.lit("ENSX"), key, F.lit("."), size))
        .when(kind == 4, F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    )
    ids = views.table(spark, folder, "part").select(
        "p_partkey",
        raw.alias("raw_id"),
        F.concat(F.lit(" C"), size, F.lit("\t")).alias("sample_id"),
    )
    return ids.select(
        "*",
        clean_feature_id(F.col("raw_id")).alias("clean_id"),
        clean_sample_id(F.col("sample_id")).alias("clean_sample"),
    )


@query(
    "camel_case",
    r"""SELECT name, array_to_string([upper(w[1]) || lower(w[2:])
                  for w in string_split_regex(name, '[^A-Za-z0-9]+') if w <> ''], '') AS class_name
       FROM (SELECT p_name || '-' || p_type || '_' || p_brand AS name FROM part)""",
)
def camel_case_names(spark, folder):
    names = views.table(spark, folder, "part").select(
        F.concat("p_name", F.lit("-"), "p_type", F.lit("_"), "p_brand").alias("name")
    )
    return names.select("name", camel_case(F.col("name")).alias("class_name"))


RUN_DIR_SQL = """CASE WHEN p_size % 4 = 0 THEN 'outputs'
                      WHEN p_size % 4 = 1 THEN 'outputs_k' || p_partkey
                      WHEN p_size % 4 = 2 THEN 'outputs_k' || p_brand
                      ELSE 'results_k' || p_size END"""


def run_dir():
    kind = F.col("p_size") % 4
    return (
        F.when(kind == 0, F.lit("outputs"))
        .when(kind == 1, F.concat(F.lit("outputs_k"), F.col("p_partkey").cast("string")))
        .when(kind == 2, F.concat(F.lit("outputs_k"), F.col("p_brand")))
        .otherwise(F.concat(F.lit("results_k"), F.col("p_size").cast("string")))
    )


@query(
    "parse_k",
    f"""SELECT p_partkey, dir_name,
              CASE WHEN dir_name = 'outputs' THEN 2000
                   WHEN regexp_full_match(dir_name, 'outputs_k[0-9]+')
                   THEN substr(dir_name, 10)::INTEGER END AS k
       FROM (SELECT p_partkey, {RUN_DIR_SQL} AS dir_name FROM part)""",
)
def parse_k(spark, folder):
    dirs = views.table(spark, folder, "part").select("p_partkey", run_dir().alias("dir_name"))
    return dirs.select("*", k_from_run_dir(F.col("dir_name")).alias("k"))


@query(
    "parse_list",
    """SELECT p_partkey, unnest(items) AS item, unnest(generate_series(0, len(items) - 1))::INTEGER AS pos
       FROM (SELECT p_partkey, [trim(w) for w in string_split(
                 p_brand || ' , ' || replace(p_name, ' ', ',, ') || ',' || p_size, ',')
                 if trim(w) <> ''] AS items FROM part)""",
)
def parse_list(spark, folder):
    spaced = F.regexp_replace("p_name", " ", ",, ")
    text = F.concat("p_brand", F.lit(" , "), spaced, F.lit(","), F.col("p_size").cast("string"))
    return views.table(spark, folder, "part").select(
        "p_partkey", F.posexplode(split_list(text)).alias("pos", "item")
    )


FILE_NAME_SQL = """CASE WHEN doc_id % 10 = 0 THEN 'harmonized-all_cancers-text-' || doc_id
                        ELSE source || '-' || lang || '-text-' || doc_id END"""


def file_index(spark, folder):
    ident = F.col("doc_id").cast("string")
    own = F.concat_ws("-", "source", "lang", F.lit("text"), ident)
    shared = F.concat(F.lit("harmonized-all_cancers-text-"), ident)
    return views.table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, shared).otherwise(own).alias("filename")
    )


def source_lists(spark, folder):
    """One list row per document: the source of the document and shared ones."""
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("audio")).otherwise(F.lit("text"))
    return views.table(spark, folder, "documents").select(
        F.concat_ws("_", "lang", "source").alias("dataset"),
        F.col("lang").alias("cohort"),
        kind.alias("data_type"),
        F.col("doc_id").alias("list_ord"),
        F.array(F.col("source"), F.lit("harmonized"), F.lit("washu")).alias("sources"),
    )


SOURCES_SQL = f"""
    SELECT cohort, data_type, source, priority::INTEGER AS priority FROM (
        SELECT cohort, data_type, unnest([source, 'harmonized', 'washu']) AS source,
               unnest([0, 1, 2]) AS priority
        FROM (SELECT lang AS cohort, CASE WHEN doc_id % 3 = 0 THEN 'audio' ELSE 'text' END AS data_type,
                     source, row_number() OVER (PARTITION BY lang, doc_id % 3 = 0 ORDER BY doc_id) AS rn
              FROM documents) WHERE rn = 1)"""
INDEX_SQL = f"SELECT {FILE_NAME_SQL} AS filename FROM documents"
MARKED_SQL = f"""
    SELECT c.*, EXISTS (SELECT 1 FROM ix WHERE starts_with(ix.filename,
               CASE WHEN source IN ('harmonized', 'mssm') THEN source || '-all_cancers-'
                    WHEN source = 'washu' AND data_type IN ('tumor_purity', 'hla_typing')
                    THEN source || '-all_cancers-'
                    ELSE source || '-' || cohort || '-' END || data_type || '-')) AS listed
    FROM c"""


@query(
    "source_select",
    f"""WITH c AS ({SOURCES_SQL}), ix AS ({INDEX_SQL}), m AS ({MARKED_SQL})
        SELECT cohort, data_type, source, priority
        FROM (SELECT *, bool_or(listed) OVER (PARTITION BY cohort, data_type) AS anyl FROM m)
        WHERE listed OR NOT anyl""",
)
def source_select(spark, folder):
    candidates = catalog.listed_sources(source_lists(spark, folder))
    return catalog.available_sources(candidates, file_index(spark, folder)).select(
        "cohort", "data_type", "source", "priority"
    )


@query(
    "source_fallback",
    """WITH a AS (SELECT lang AS cohort, 'text' AS data_type, source,
                         unnest(['get_a', 'get_b', 'get_c']) AS method,
                         unnest([0, 1, 2]) AS mp, n_chars
                  FROM documents)
       SELECT cohort, data_type, method, source FROM (
           SELECT *, row_number() OVER (PARTITION BY cohort, data_type ORDER BY mp, source) AS rn
           FROM a WHERE n_chars % 3 = mp AND n_chars > 1000) WHERE rn = 1""",
)
def source_fallback(spark, folder):
    methods = F.array(
        *[
            F.struct(F.lit(name).alias("method"), F.lit(i).alias("method_priority"))
            for i, name in enumerate(["get_a", "get_b", "get_c"])
        ]
    )
    attempts = views.table(spark, folder, "documents").select(
        F.col("lang").alias("cohort"),
        F.lit("text").alias("data_type"),
        "source",
        F.col("source").alias("source_priority"),
        "n_chars",
        F.inline(methods),
    )
    usable = (F.col("n_chars") % 3 == F.col("method_priority")) & (F.col("n_chars") > 1000)
    return catalog.first_available(attempts.withColumn("available", usable))


@query(
    "summary_upsert",
    """WITH shapes AS (
           SELECT assay, cohort, count(DISTINCT sample_id) AS n_rows FROM all_cells GROUP BY ALL)
       SELECT cohort, n_rows, 'new' AS origin FROM shapes WHERE assay = 'proteomics'
       UNION ALL
       SELECT cohort, n_rows, 'old' FROM (
           SELECT n_name AS cohort, count(*) AS n_rows FROM customer
           JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
           UNION ALL SELECT cohort, n_rows FROM shapes WHERE assay = 'transcriptomics')
       WHERE cohort NOT IN (SELECT cohort FROM shapes WHERE assay = 'proteomics')""",
)
def summary_upsert(spark, folder):
    samples = combine.sample_dimension(views.all_cells(spark, folder))
    shapes = samples.groupBy("assay", "cohort").agg(F.countDistinct("sample_id").alias("n_rows"))
    nations = (
        views.table(spark, folder, "customer")
        .join(views.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("cohort"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    old = shapes.filter(F.col("assay") == RNA).select("cohort", "n_rows").unionByName(nations)
    new = shapes.filter(F.col("assay") == PROTEIN).select("cohort", "n_rows")
    return sinks.upsert_summary(
        old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), ["cohort"]
    )


@query(
    "metrics_normalize",
    f"""SELECT protein, iteration, round(r2, 6) AS r2, round(mae, 6) AS mae, NULL::DOUBLE AS rmse, k FROM (
          SELECT trim(target) AS protein, iteration, coalesce(rf_r2, r2) AS r2,
                 coalesce(rf_mae, mae) AS mae,
                 CASE WHEN dir_name = 'outputs' THEN 2000
                      WHEN regexp_full_match(dir_name, 'outputs_k[0-9]+')
                      THEN substr(dir_name, 10)::INTEGER END AS k
          FROM (SELECT {RUN_DIR_SQL} AS dir_name, l_orderkey AS iteration,
                       CASE WHEN l_linenumber = 3 THEN '  ' ELSE ' ' || p_type || ' ' END AS target,
                       CASE WHEN l_returnflag <> 'A' THEN l_discount END AS rf_r2, l_tax AS r2,
                       CASE WHEN l_returnflag = 'R' THEN l_quantity END AS rf_mae,
                       CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS mae
                FROM lineitem JOIN part ON l_partkey = p_partkey))
        WHERE protein <> '' AND k IS NOT NULL""",
)
def metrics_normalize(spark, folder):
    flag = F.col("l_returnflag")
    blank = F.col("l_linenumber") == 3
    rows = (
        views.table(spark, folder, "lineitem")
        .join(views.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            run_dir().alias("run_dir"),
            F.col("l_orderkey").alias("iteration"),
            F.when(blank, F.lit("  "))
            .otherwise(F.concat(F.lit(" "), "p_type", F.lit(" ")))
            .alias("target"),
            F.when(flag != "A", F.col("l_discount")).alias("rf_r2"),
            F.col("l_tax").alias("r2"),
            F.when(flag == "R", F.col("l_quantity")).alias("rf_mae"),
            F.when(flag != "N", F.col("l_extendedprice")).alias("mae"),
            F.lit(None).cast("double").alias("rmse"),
        )
    )
    return metrics.normalize_metrics(rows).select(
        "protein", "iteration", rounded("r2"), rounded("mae"), "rmse", "k"
    )


def _grid_sql() -> str:
    import json

    pieces, stride = [], 1
    for name, values in search.GRID.items():
        options = ", ".join("'" + json.dumps(value) + "'" for value in values)
        pieces.append(f"'{json.dumps(name)}: ' || [{options}][(i // {stride}) % {len(values)} + 1]")
        stride *= len(values)
    return "'{' || " + " || ', ' || ".join(pieces) + " || '}'"


@query(
    "param_draws",
    f"""WITH d AS (SELECT {_grid_sql()} AS params,
                          row_number() OVER (ORDER BY md5(i || ':42'), i) AS draw
                   FROM range({prod(map(len, search.GRID.values()))}) t(i))
        SELECT target, draw, params
        FROM (SELECT DISTINCT feature AS target FROM protein_matrix) CROSS JOIN d WHERE draw <= 30""",
)
def param_draws(spark, folder):
    targets = views.protein_matrix(spark, folder).select(F.col("feature").alias("target"))
    return search.search_plan(targets.distinct(), search.parameter_draws(spark))


@query(
    "raw_tables",
    """SELECT cohort, 'transcriptomics' AS assay, count(*) AS n_cells,
              count(DISTINCT sample_id) AS n_samples, count(DISTINCT sample_id) AS n_rows,
              count(DISTINCT (feature_name, database_id)) AS n_features, round(sum(value), 3) AS total
       FROM rna_genes GROUP BY cohort""",
)
def raw_tables(spark, folder):
    """Wide raw tables, a folder of part files for each cohort, found and read back."""
    root = scratch_path(spark, "raw files")
    genes = materialize(views.rna_genes(spark, folder), "genes", ["cohort"])
    label = F.concat(F.lit("('"), "feature_name", F.lit("', '"), "database_id", F.lit("')"))
    labelled = genes.withColumn("label", label)
    for name in [row.cohort for row in genes.select("cohort").distinct().collect()]:
        wide = labelled.filter(F.col("cohort") == name).groupBy("sample_id").pivot("label")
        wide.agg(F.avg("value")).repartition(3).write.parquet(f"{root}/{name}/transcriptomics.parquet")
    found = combining.raw_cells(spark, root, index="sample_id")
    return found.groupBy("cohort", "assay").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.countDistinct("occ").alias("n_rows"),
        F.countDistinct("feature_name", "database_id").alias("n_features"),
        F.round(F.sum("value"), 3).alias("total"),
    )
