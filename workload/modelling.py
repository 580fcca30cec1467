"""Alignment, split, selection and report queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from assayframe.operators import align, combine, reports, selection, split
from assayframe.operators.joins import first_per_key
from assayframe.sources.scratch import materialize
from workload import views
from workload.registry import query
from workload.tables import rounded


# ---- stages shared by the queries below -------------------------------------


def matrices(spark, folder):
    """Both matrices as stored tables: every later stage reads them again."""
    sales = views.stored_sales(spark, folder)
    store = inheritable_thread_target(spark)(materialize)
    with ThreadPoolExecutor(2) as pool:
        rna = pool.submit(store, views.rna_matrix(spark, folder, sales), "rna")
        protein = pool.submit(store, views.protein_matrix(spark, folder, sales), "protein")
        return rna.result(), protein.result()


def resolved(protein):
    asked = align.requested_targets(protein.sparkSession, views.TARGETS)
    return align.resolve_targets(asked, protein)


def labels(rna, protein):
    return align.target_values(resolved(protein), protein, align.complete_samples(rna, protein))


def placed(rna, protein):
    # The split numbers the rows and counts them, so it reads them twice.
    return split.train_test_split(materialize(labels(rna, protein), "labels"))


def training(rna, protein):
    """Training cells and rows, stored as in a modelling run."""
    rows = placed(rna, protein).filter(F.col("split") == "train")
    rows = materialize(rows.select("target", "sample_id", "y"), "rows")
    return materialize(align.align_target(rows, rna), "observed"), rows


def statistics(spark, folder):
    return selection.feature_statistics(*training(*matrices(spark, folder)))


# ---- alignment ----------------------------------------------------------------


@query(
    "select_value_type",
    """SELECT 'raw' AS value_type, count(*) AS n FROM rna_genes""",
)
def select_value_type(spark, folder):
    genes = materialize(views.rna_genes(spark, folder), "genes")
    blocks = combine.value_blocks(combine.zscore(genes))
    return align.select_value_type(blocks).groupBy("value_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "feature_matrix",
    "SELECT feature, sample_id, round(value, 6) AS value FROM rna_matrix",
)
def feature_matrix(spark, folder):
    return views.rna_matrix(spark, folder).select("feature", "sample_id", rounded("value"))


@query(
    "common_samples",
    "SELECT sample_id FROM rna_matrix INTERSECT SELECT sample_id FROM protein_matrix",
)
def common_samples(spark, folder):
    return align.common_samples(
        views.rna_matrix(spark, folder), views.protein_matrix(spark, folder)
    )


def listed_features(spark, folder):
    """Features of the matrix and one that has no value in any sample."""
    part = views.table(spark, folder, "part")
    without = part.filter(F.col("p_type") == "PROMO").select(F.col("p_type").alias("feature"))
    return part.select(F.col("p_brand").alias("feature")).union(without).distinct()


@query(
    "sample_filter",
    """WITH nf AS (SELECT count(DISTINCT feature) AS nf FROM (
           SELECT p_brand AS feature FROM part
           UNION ALL SELECT p_type FROM part WHERE p_type = 'PROMO')),
       m AS (SELECT cohort, sample_id, occ, count(value) AS n FROM rna_matrix GROUP BY ALL)
       SELECT sample_id, nf - max(n) AS n_missing, nf AS n_features
       FROM m CROSS JOIN nf WHERE sample_id IN (SELECT sample_id FROM protein_matrix)
       GROUP BY sample_id, nf HAVING 5 * (nf - max(n)) <= nf""",
)
def sample_filter(spark, folder):
    rna, protein = matrices(spark, folder)
    kept = align.complete_samples(rna, protein, features=listed_features(spark, folder))
    return kept.select("sample_id", "n_missing", "n_features")


@query("resolve_targets", "SELECT target, resolved, found FROM resolved")
def resolve_targets(spark, folder):
    found = resolved(views.protein_matrix(spark, folder))
    return found.select("target", "resolved", "found")


@query(
    "target_xy",
    """SELECT l.target, l.sample_id, m.feature, round(m.value, 6) AS x, round(l.y, 6) AS y
       FROM labels_y l JOIN rna_matrix m USING (sample_id)""",
)
def target_xy(spark, folder):
    rna, protein = matrices(spark, folder)
    aligned = align.align_target(labels(rna, protein), rna)
    return aligned.select("target", "sample_id", "feature", rounded("x"), rounded("y"))


@query(
    "dedupe_first",
    """SELECT 'C' || o_custkey AS sample_id, min(o_orderkey) AS occ
       FROM orders GROUP BY o_custkey""",
)
def dedupe_first(spark, folder):
    occurrences = views.table(spark, folder, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sample_id"),
        F.col("o_orderkey").alias("occ"),
    )
    return first_per_key(occurrences, ["sample_id"], ["occ"])


@query(
    "infer_orientation",
    """SELECT regexp_matches(min_by(cohort, sample_id), '[0-9]')
                  AND regexp_matches(min_by(cohort, sample_id), '[A-Za-z]') AS rows_look_like_samples,
              regexp_matches(min(feature), '[0-9]') AND regexp_matches(min(feature), '[A-Za-z]')
                  AS cols_look_like_samples,
              count(DISTINCT sample_id) AS n_rows, count(DISTINCT feature) AS n_cols,
              false AS transpose
       FROM rna_matrix""",
)
def infer_orientation(spark, folder):
    # Many rows share a label; each of them counts.
    return align.infer_orientation(
        views.rna_matrix(spark, folder), "cohort", "sample_id", "feature", "feature"
    )


# ---- split ----------------------------------------------------------------------


@query(
    "train_test_split",
    """SELECT target, sample_id, CASE WHEN pos <= n_test THEN 'test' ELSE 'train' END AS split
       FROM placed""",
)
def train_test_split(spark, folder):
    return placed(*matrices(spark, folder)).select("target", "sample_id", "split")


@query("cv_folds", "SELECT target, sample_id, fold FROM folds")
def cv_folds(spark, folder):
    return split.assign_folds(placed(*matrices(spark, folder))).select("target", "sample_id", "fold")


# ---- imputation, scaling and selection ------------------------------------------


@query(
    "impute_median",
    """SELECT target, feature, round(median, 6) AS median, n - n_observed AS n_imputed
       FROM scored""",
)
def impute_median(spark, folder):
    return statistics(spark, folder).select("target", "feature", rounded("median"), "n_imputed")


@query(
    "scale_features",
    """SELECT target, feature, round(mean, 6) AS mean, round(std, 6) AS std,
              round(CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS scale FROM scored""",
)
def scale_features(spark, folder):
    return statistics(spark, folder).select(
        "target", "feature", rounded("mean"), rounded("std"), rounded("scale")
    )


@query(
    "scale_cells",
    """WITH s AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std
                  FROM embedding_cells GROUP BY feature)
       SELECT sample_id, feature, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS z
       FROM embedding_cells JOIN s USING (feature)""",
)
def scale_cells(spark, folder):
    cells = views.embedding_cells(spark, folder)
    rows = cells.select("target", "sample_id", "y").distinct()
    stats = selection.feature_statistics(cells, rows)
    return selection.scale_cells(cells, stats, ["target"]).select(
        "sample_id", "feature", rounded("z")
    )


@query(
    "f_regression",
    """SELECT target, feature, n, round(r, 6) AS r, round(f_score, 6) AS f_score FROM f_scores""",
)
def f_regression(spark, folder):
    return statistics(spark, folder).select(
        "target", "feature", "n", rounded("r"), rounded("f_score")
    )


@query("select_k_best", "SELECT target, feature, rank FROM ranked WHERE rank <= 10")
def select_k_best(spark, folder):
    return selection.rank_features(statistics(spark, folder), 10).select(
        "target", "feature", "rank"
    )


SWEEP = [2, 4, 6, 8, 10, 12, 14, 16, 18]


@query(
    "k_sweep_selection",
    """SELECT target, k, feature, rank
       FROM ranked JOIN (SELECT (2 * i)::INTEGER AS k FROM range(1, 10) t(i)) ON rank <= k""",
)
def k_sweep_selection(spark, folder):
    return selection.sweep_selection(statistics(spark, folder), SWEEP).select(
        "target", "k", "feature", "rank"
    )


@query(
    "sweep_pending",
    """SELECT target, k
       FROM (SELECT DISTINCT feature AS target FROM protein_matrix)
       CROSS JOIN (SELECT (2 * i)::INTEGER AS k FROM range(1, 10) t(i))
       WHERE (target, k) NOT IN (
           SELECT (p_brand, (l_linenumber * 2)::INTEGER)
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')""",
)
def sweep_pending(spark, folder):
    targets = views.protein_matrix(spark, folder).select(F.col("feature").alias("target"))
    done = (
        views.table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .join(views.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("p_brand").alias("target"), (F.col("l_linenumber") * 2).alias("k"))
        .distinct()
    )
    return selection.pending_runs(targets.distinct(), SWEEP, done)


# ---- reports ----------------------------------------------------------------------


@query(
    "regression_metrics",
    """SELECT target, count(*) AS n,
              round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 6) AS r2,
              round(avg(abs(y - prediction)), 6) AS mae,
              round(covar_pop(y, prediction)
                    / nullif(stddev_pop(y) * stddev_pop(prediction), 0), 6) AS pearson
       FROM predictions GROUP BY target""",
)
def regression_metrics(spark, folder):
    return reports.regression_metrics(views.predictions(spark, folder)).select(
        "target", "n", rounded("r2"), rounded("mae"), rounded("pearson")
    )


@query(
    "prediction_range",
    """SELECT target, round(least(min(y), min(prediction)), 4) AS lo,
              round(greatest(max(y), max(prediction)), 4) AS hi
       FROM predictions GROUP BY target""",
)
def prediction_range(spark, folder):
    ends = reports.prediction_range(views.predictions(spark, folder))
    return ends.select("target", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(
    "cv_scores",
    """WITH by_fold AS (
           SELECT target, draw, fold,
                  1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2
           FROM predictions GROUP BY ALL),
       s AS (SELECT target, draw, avg(r2) AS mean_r2 FROM by_fold GROUP BY ALL)
       SELECT target, draw, round(mean_r2, 6) AS mean_r2,
              row_number() OVER (PARTITION BY target ORDER BY mean_r2 DESC, draw) = 1 AS is_best
       FROM s""",
)
def cv_scores(spark, folder):
    return reports.cv_scores(views.predictions(spark, folder)).select(
        "target", "draw", rounded("mean_r2"), "is_best"
    )


@query(
    "top_features",
    """SELECT target, feature, round(importance, 9) AS importance, rank
       FROM (SELECT *, row_number() OVER (PARTITION BY target
                                          ORDER BY importance DESC, feature) AS rank
             FROM importances) WHERE rank <= 50""",
)
def top_features(spark, folder):
    return reports.top_features(views.importances(spark, folder)).select(
        "target", "feature", F.round("importance", 9).alias("importance"), "rank"
    )


@query(
    "target_in_top50",
    """WITH shares AS (
           SELECT p_type AS target, p_name AS feature,
                  sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS importance
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
           UNION ALL
           SELECT p_type, p_type, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE p_size > 25 GROUP BY p_type)
       SELECT target, coalesce(bool_or(feature = target), false) AS in_top50
       FROM (SELECT *, row_number() OVER (PARTITION BY target
                                          ORDER BY importance DESC, feature) AS rank FROM shares)
       WHERE rank <= 50 GROUP BY target""",
)
def target_in_top50(spark, folder):
    lines = views.table(spark, folder, "lineitem").join(
        views.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    others = lines.groupBy(F.col("p_type").alias("target"), F.col("p_name").alias("feature")).agg(
        F.sum(cents).alias("importance")
    )
    own = (
        lines.filter(F.col("p_size") > 25)
        .groupBy(F.col("p_type").alias("target"))
        .agg(F.count(F.lit(1)).alias("importance"))
        .select("target", F.col("target").alias("feature"), "importance")
    )
    return reports.target_in_top(reports.top_features(others.unionByName(own)))


@query(
    "accuracy_gap",
    """WITH firsts AS (
           SELECT target, rf_r2 FROM (
               SELECT protein AS target, r2 AS rf_r2,
                      row_number() OVER (PARTITION BY protein ORDER BY k, iteration) AS rn
               FROM metric_rows) WHERE rn = 1)
       SELECT d.target AS driver, c.target AS control,
              round(d.rf_r2 - c.rf_r2, 6) AS accuracy_gap_rf_r2
       FROM (VALUES ('PROMO', 'STANDARD'), ('ECONOMY', 'STANDARD'), ('ECONOMY', 'NONE'))
            p(driver, control)
       JOIN firsts d ON d.target = p.driver JOIN firsts c ON c.target = p.control""",
)
def accuracy_gap(spark, folder):
    metrics = views.metric_rows(spark, folder).select(
        F.col("protein").alias("target"), F.col("r2").alias("rf_r2"), "k", "iteration"
    )
    pairs = [("PROMO", "STANDARD"), ("ECONOMY", "STANDARD"), ("ECONOMY", "NONE")]
    gaps = reports.accuracy_gap(metrics, F.struct("k", "iteration"), pairs)
    return gaps.select("driver", "control", rounded("accuracy_gap_rf_r2"))


@query(
    "elbow_summary",
    """SELECT protein, k, round(log10(k), 6) AS log10_k, round(avg(r2), 6) AS mean,
              round(stddev_samp(r2), 6) AS std, round(coalesce(stddev_samp(r2), 0), 6) AS std_or_zero
       FROM metric_rows WHERE r2 IS NOT NULL AND k BETWEEN 2 AND 20 GROUP BY protein, k""",
)
def elbow_summary(spark, folder):
    return reports.elbow_table(views.metric_rows(spark, folder)).select(
        "protein", "k", rounded("log10_k"), rounded("mean"), rounded("std"),
        rounded("std_or_zero"),
    )


@query(
    "knee_detect",
    """WITH s AS (SELECT protein, k, avg(r2) AS m FROM metric_rows GROUP BY ALL),
       d AS (SELECT *, m - lag(m) OVER w AS g FROM s WINDOW w AS (PARTITION BY protein ORDER BY k)),
       f AS (SELECT *, g < 0.01 AND lead(g, 1) OVER w < 0.01 AND lead(g, 2) OVER w < 0.01 AS flat
             FROM d WINDOW w AS (PARTITION BY protein ORDER BY k))
       SELECT protein, CASE WHEN count(*) >= 4 THEN min(CASE WHEN flat THEN k END) END AS knee_k
       FROM f GROUP BY protein""",
)
def knee_detect(spark, folder):
    summary = reports.metric_summary(views.metric_rows(spark, folder))
    return reports.detect_knee(summary)
