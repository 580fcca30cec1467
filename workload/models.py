"""Model queries: ridges against their closed form, forests against the same trees
grown in SQL, and a search over the whole grid."""

from __future__ import annotations

import json
from math import prod

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from assayframe.operators import design, forests, models, ridge, search, selection, split, trees
from assayframe.plans import modelling as plan
from assayframe.sources.scratch import materialize, scratch_path
from workload import modelling, views
from workload.registry import query
from workload.tables import rounded

def ridge_design(spark, folder, k=2):
    rna, protein = modelling.matrices(spark, folder)
    rows = materialize(design.folded_rows(modelling.placed(rna, protein)), "rows")
    observed = materialize(design.observed_cells(rows, rna), "observed")
    train = rows.filter("split = 'train'")
    statistics = selection.feature_statistics(
        observed.filter("split = 'train'"), train
    ).withColumn("fit", F.lit(design.FULL_FIT))
    selected = materialize(selection.rank_features(statistics, k), "selected")
    full = rows.withColumn("fold", F.lit(0))
    table = design.design_rows(full, observed, selected, folds=0)
    return materialize(table, "design", design.FIT), selected


# Ridge on the two best features, solved in closed form.
RIDGE_SQL = """top AS (SELECT target, feature, rank, n, mean, CASE WHEN std = 0 THEN 1 ELSE std END AS s
                    FROM ranked WHERE rank <= 2),
       z AS (SELECT f.target, f.sample_id, f.y, t.rank, (f.x - t.mean) / t.s AS z
             FROM filled f JOIN top t USING (target, feature)),
       p AS (SELECT target, sample_id, any_value(y) AS y,
                    max(CASE WHEN rank = 1 THEN z END) AS z1, max(CASE WHEN rank = 2 THEN z END) AS z2
             FROM z GROUP BY ALL),
       g AS (SELECT target, sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS d,
                    sum(z1 * (y - m)) AS u, sum(z2 * (y - m)) AS v, any_value(m) AS m
             FROM p JOIN (SELECT target, avg(y) AS m FROM train GROUP BY ALL) USING (target)
             GROUP BY target),
       w AS (SELECT target, feature, rank, mean, s, m,
                    CASE WHEN rank = 1 THEN (d * u - b * v) ELSE (a * v - b * u) END
                        / (a * d - b * b) AS coefficient
             FROM g JOIN top USING (target))"""


@query(
    "ridge_baseline",
    f"""WITH {RIDGE_SQL}
       SELECT target, feature, round(coefficient, 6) AS coefficient, round(m, 6) AS intercept
       FROM w""",
)
def ridge_baseline(spark, folder):
    table, selected = ridge_design(spark, folder)
    weights = ridge.fit_ridges(table).select(
        "target", "intercept", F.posexplode("coefficients").alias("at", "coefficient")
    )
    return (
        selected.join(weights.withColumn("rank", F.col("at") + 1), ["target", "rank"])
        .select("target", "feature", rounded("coefficient"), rounded("intercept"))
    )


@query(
    "ridge_predictions",
    f"""WITH {RIDGE_SQL},
       t AS (SELECT target, sample_id, y FROM placed WHERE pos <= n_test),
       e AS (SELECT t.target, t.sample_id, t.y, w.m,
                    w.coefficient * (coalesce(r.value, d.median) - w.mean) / w.s AS part
             FROM t JOIN w USING (target) JOIN medians d USING (target, feature)
             LEFT JOIN rna_matrix r ON r.sample_id = t.sample_id AND r.feature = w.feature)
       SELECT target, sample_id, round(any_value(y), 6) AS y,
              round(any_value(m) + sum(part), 6) AS prediction
       FROM e GROUP BY target, sample_id""",
)
def ridge_predictions(spark, folder):
    table, _ = ridge_design(spark, folder)
    predicted = ridge.predict(ridge.fit_ridges(table), table.filter("role = 'test'"))
    return predicted.select("target", "sample_id", rounded("y"), rounded("prediction"))


# Every fit ranks on its own training rows: the full one (-1) and one per fold.
FITS_SQL = """fits AS (SELECT i::INTEGER AS fit FROM range(-1, 5) t(i)),
    ft AS (SELECT target, fit, sample_id, y FROM folds JOIN fits ON fit <> fold),
    fo AS (SELECT ft.*, m.feature, m.value AS x FROM ft JOIN rna_matrix m USING (sample_id)),
    fm AS (SELECT target, fit, feature, median(x) AS median FROM fo GROUP BY ALL),
    ff AS (SELECT ft.target, ft.fit, ft.y, fm.feature, coalesce(fo.x, fm.median) AS x, fm.median
           FROM ft JOIN fm ON ft.target = fm.target AND ft.fit = fm.fit
           LEFT JOIN fo ON fo.target = ft.target AND fo.fit = ft.fit
                       AND fo.sample_id = ft.sample_id AND fo.feature = fm.feature),
    fr AS (SELECT target, fit, feature, count(*) AS n, any_value(median) AS median,
                  covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r
           FROM ff GROUP BY ALL),
    fk AS (SELECT target, fit, feature, median,
                  row_number() OVER (PARTITION BY target, fit
                      ORDER BY coalesce(r * r / nullif(1 - r * r, 0) * (n - 2), 0) DESC,
                               feature DESC) AS rank
           FROM fr)"""


def fold_design(spark, folder, k=5):
    rna, protein = modelling.matrices(spark, folder)
    rows = materialize(design.folded_rows(modelling.placed(rna, protein)), "rows")
    observed = materialize(design.observed_cells(rows, rna), "observed")
    statistics = design.fit_statistics(observed, rows)
    selected = materialize(selection.rank_features(statistics, k, design.FIT), "selected")
    return rows, observed, selected


@query(
    "fold_selection",
    f"""WITH {FITS_SQL}
        SELECT target, fit, feature, rank, round(median, 6) AS median FROM fk WHERE rank <= 5""",
)
def fold_selection(spark, folder):
    _, _, selected = fold_design(spark, folder)
    return selected.select("target", "fit", "feature", "rank", rounded("median"))


@query(
    "design_rows",
    f"""WITH {FITS_SQL},
        roles AS (SELECT target, sample_id, y, -1 AS fit, 'test' AS role FROM placed WHERE pos <= n_test
                  UNION ALL
                  SELECT target, sample_id, y, fit,
                         CASE WHEN fit = fold THEN 'valid' ELSE 'train' END FROM folds CROSS JOIN fits)
        SELECT r.target, r.fit, r.role, r.sample_id, (k.rank - 1)::INTEGER AS pos,
               round(coalesce(m.value, k.median), 6) AS x
        FROM roles r JOIN fk k ON k.target = r.target AND k.fit = r.fit AND k.rank <= 5
        LEFT JOIN rna_matrix m ON m.sample_id = r.sample_id AND m.feature = k.feature""",
)
def design_rows(spark, folder):
    table = design.design_rows(*fold_design(spark, folder))
    return table.select(
        "target", "fit", "role", "sample_id", F.posexplode("features").alias("pos", "x")
    ).withColumn("x", F.round("x", 6))


# ---- forests ------------------------------------------------------------------------


def _embedding_run(spark, folder):
    cells = views.embedding_cells(spark, folder)
    keys = [F.lit("all").alias("cohort"), "sample_id", F.lit(0).cast("long").alias("occ")]
    rna = materialize(cells.select(*keys, "feature", F.col("x").alias("value")), "rna")
    labels = cells.select("sample_id", "target", "y").distinct()
    protein = materialize(
        labels.select(*keys, F.col("target").alias("feature"), F.col("y").alias("value")),
        "protein",
    )
    return rna, protein


# A search that SQL can follow tree by tree: the whole grid but for the number of trees.
CHECKED_GRID = {**search.GRID, "model__n_estimators": [3, 5]}
CHECKED = plan.Settings(k_best=2, n_iter=3, grid=CHECKED_GRID)
# One forest of every kind of limit, and one tree without any chance.
FOREST = {
    "model__n_estimators": 8,
    "model__max_depth": None,
    "model__min_samples_split": 5,
    "model__min_samples_leaf": 2,
    "model__max_features": "sqrt",
    "model__bootstrap": True,
}
TREE = {**FOREST, "model__n_estimators": 1, "model__min_samples_split": 2, "model__min_samples_leaf": 1,
        "model__max_features": None, "model__bootstrap": False}


def mixed_sql(a: str, b: str) -> str:
    step = f"% {trees.PRIME}"
    return (
        f"list_reduce([({a} * 48271 + {b} * 16807 + 1) {step}, 1, 2]::BIGINT[], lambda s, i: CASE i"
        f" WHEN 1 THEN (s * s + 39373 * s + 7) {step} ELSE (s * s + 69621 * s + 3) {step} END)"
    )


def design_sql(k: int) -> str:
    """Rows of every fit over the embeddings with their ``k`` best features in order."""
    return f"""
    e AS (SELECT 'V' || vec_id AS sample_id, label::DOUBLE AS y, embedding FROM embeddings),
    p AS (SELECT *, row_number() OVER (ORDER BY md5(sample_id || ':42'), sample_id) AS pos,
                 ceil(0.2::DOUBLE * count(*) OVER ())::BIGINT AS n_test,
                 list_reduce(list_transform(string_split(substr(md5(sample_id || ':42'), 1, 7), ''),
                     lambda c: instr('0123456789abcdef', c)::BIGINT - 1), lambda a, b: 16 * a + b) AS row_key
          FROM e),
    q AS (SELECT *, CASE WHEN pos > n_test THEN ntile(5) OVER (PARTITION BY pos > n_test ORDER BY pos) - 1 END AS fold
          FROM p),
    roles AS (SELECT * FROM (
        SELECT fit, sample_id, y, row_key, embedding,
               CASE WHEN pos <= n_test THEN CASE WHEN fit = -1 THEN 'test' END
                    WHEN fit = fold THEN 'valid' ELSE 'train' END AS role
        FROM q CROSS JOIN (SELECT f::INTEGER AS fit FROM range(-1, 5) t(f))) WHERE role IS NOT NULL),
    cells AS (SELECT fit, role, sample_id, y, i, embedding[i + 1]::DOUBLE AS x
              FROM (SELECT *, unnest(range(len(embedding))) AS i FROM roles)),
    sc AS (SELECT fit, i, 'd' || i AS feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std,
                  covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r
           FROM cells WHERE role = 'train' GROUP BY fit, i),
    rk AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY
                  coalesce(r * r / nullif(1 - r * r, 0) * (n - 2), 0) DESC, feature DESC) AS rank FROM sc),
    fr AS (SELECT c.fit, c.role, c.sample_id, any_value(c.y) AS y, any_value(p.row_key) AS row_key,
                  list(c.x ORDER BY k.rank) AS feats
           FROM cells c JOIN rk k USING (fit, i) JOIN p USING (sample_id) WHERE k.rank <= {k}
           GROUP BY c.fit, c.role, c.sample_id)"""


def units_sql(draws: str, fits: str) -> str:
    return f"un AS (SELECT * FROM ({draws}) d CROSS JOIN ({fits}) f)"


def one_draw(params: dict, k: int) -> str:
    p = trees.tree_params(params, k)
    depth = "NULL" if p.max_depth is None else p.max_depth
    return f"""SELECT 1::BIGINT AS draw, {p.trees} AS n_trees, {depth}::INTEGER AS max_depth, {p.min_split} AS min_split,
        {p.min_leaf} AS min_leaf, {p.features} AS tried, {str(p.bootstrap).lower()} AS bootstrap"""


def drawn_sql(grid: dict, n_iter: int, k: int) -> str:
    """The draws of a search, numbered, with what they set and as text."""
    columns, texts, stride = [], [], 1
    names = {"n_estimators": "n_trees", "max_depth": "max_depth", "min_samples_split": "min_split",
             "min_samples_leaf": "min_leaf", "max_features": "tried", "bootstrap": "bootstrap"}
    for name, values in grid.items():
        at = f"[(i // {stride}) % {len(values)} + 1]"
        short = name.removeprefix("model__")
        listed = [trees.features_tried(v, k) if short == "max_features" else v for v in values]
        columns.append(f"[{', '.join('NULL' if v is None else str(v).lower() for v in listed)}]{at} AS {names[short]}")
        texts.append(f"'{json.dumps(name)}: ' || [" + ", ".join(f"'{json.dumps(v)}'" for v in values) + f"]{at}")
        stride *= len(values)
    return f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY md5(i || ':42'), i) AS draw, {', '.join(columns)},
        '{{' || {" || ', ' || ".join(texts)} || '}}' AS params
        FROM range({prod(map(len, grid.values()))}) t(i)) WHERE draw <= {n_iter}"""


def grown_sql(rows: str = "fr", units: str = "un", name: str = "g") -> str:
    """Trees grown level by level: each row with its node (a path), and at last the
    value of its leaf. ``via`` is the feature that led to a node."""
    drawn = f"len(list_filter({trees.DRAWN_FROM}, lambda e: number >= e))"
    return f"""
    ct AS (SELECT fit, round_even(avg(y), 0) AS centre FROM {rows} WHERE role = 'train' GROUP BY fit),
    {name}_seeds AS (SELECT u.*, tree, {mixed_sql(str(split.SEED), "tree")} AS key
                     FROM (SELECT *, unnest(range(1, n_trees + 1)) AS tree FROM {units}) u),
    {name}_rows AS (SELECT s.fit, s.draw, s.tree, s.key, r.sample_id, r.role, r.y - c.centre AS ys, r.feats,
               {mixed_sql("s.key", "r.row_key")} AS number, s.bootstrap,
               s.max_depth, s.min_split, s.min_leaf, s.tried
        FROM {name}_seeds s JOIN {rows} r ON r.fit = s.fit JOIN ct c ON c.fit = r.fit),
    {name}(fit, draw, tree, path, key, via, sample_id, times, ys, feats, max_depth, min_split, min_leaf, tried, value) AS (
        SELECT * FROM (
            SELECT fit, draw, tree, '', key, -1::BIGINT, sample_id,
                   CASE WHEN role <> 'train' THEN 0 WHEN bootstrap THEN {drawn} ELSE 1 END AS times,
                   ys, feats, max_depth, min_split, min_leaf, tried, NULL::DOUBLE
            FROM {name}_rows WHERE role <> 'train' OR NOT bootstrap OR {drawn} > 0)
        UNION ALL
        (WITH cur AS (SELECT * FROM {name} WHERE value IS NULL),
        st AS (SELECT fit, draw, tree, path, any_value(key) AS key, count(*) AS n, sum(times)::DOUBLE AS w,
                      sum(times * ys) AS s, min(ys) < max(ys) AS mixed, any_value(max_depth) AS max_depth,
                      any_value(min_split) AS min_split, any_value(min_leaf) AS min_leaf,
                      any_value(tried) AS tried, any_value(len(feats)) AS width
               FROM cur WHERE times > 0 GROUP BY fit, draw, tree, path),
        vis AS (SELECT *, row_number() OVER (PARTITION BY fit, draw, tree, path ORDER BY h, f) - 1 AS visit
                FROM (SELECT *, {mixed_sql("key", "f")} AS h FROM (
                    SELECT *, unnest(range(width)) AS f FROM st
                    WHERE mixed AND n >= greatest(min_split, 2 * min_leaf)
                      AND coalesce(length(path) < max_depth, true)))),
        val AS (SELECT v.*, c.times, c.ys, c.feats[v.f + 1] AS x
                FROM vis v JOIN cur c ON c.fit = v.fit AND c.draw = v.draw AND c.tree = v.tree AND c.path = v.path
                WHERE c.times > 0),
        lim AS (SELECT fit, draw, tree, path, greatest(any_value(tried) - 1,
                       coalesce(min(CASE WHEN lo < hi THEN visit END), 0)) AS last
                FROM (SELECT fit, draw, tree, path, visit, any_value(tried) AS tried, min(x) AS lo, max(x) AS hi
                      FROM val GROUP BY fit, draw, tree, path, visit) GROUP BY fit, draw, tree, path),
        grp AS (SELECT fit, draw, tree, path, f, visit, x, any_value(n) AS n, any_value(w) AS w, any_value(s) AS s,
                       any_value(min_leaf) AS min_leaf, sum(times)::DOUBLE AS tw, sum(times * ys) AS ts, count(*) AS tn
                FROM val JOIN lim USING (fit, draw, tree, path) WHERE visit <= last
                GROUP BY fit, draw, tree, path, f, visit, x),
        cum AS (SELECT *, sum(tw) OVER o AS lw, sum(ts) OVER o AS ls, sum(tn) OVER o AS ln, lead(x) OVER o AS nx
                FROM grp WINDOW o AS (PARTITION BY fit, draw, tree, path, f ORDER BY x)),
        best AS (SELECT fit, draw, tree, path, f, CASE WHEN x / 2 + nx / 2 >= nx THEN x ELSE x / 2 + nx / 2 END AS cut
                 FROM (SELECT *, row_number() OVER (PARTITION BY fit, draw, tree, path ORDER BY
                              ls * ls / lw + (s - ls) * (s - ls) / (w - lw) DESC, visit, x) AS place
                       FROM cum WHERE nx IS NOT NULL AND ln >= min_leaf AND n - ln >= min_leaf) WHERE place = 1),
        nxt AS (SELECT c.*, b.f, (c.feats[b.f + 1] > b.cut)::BIGINT AS side, st.s / st.w AS mean
                FROM cur c JOIN st USING (fit, draw, tree, path) LEFT JOIN best b USING (fit, draw, tree, path))
        SELECT fit, draw, tree, path || coalesce(side::VARCHAR, ''),
               CASE WHEN side IS NULL THEN key ELSE {mixed_sql("key", "side")} END, coalesce(f, via),
               sample_id, times, ys, feats, max_depth, min_split, min_leaf, tried,
               CASE WHEN side IS NULL THEN mean END
        FROM nxt))"""


def predicted_sql(name: str = "g", rows: str = "fr") -> str:
    return f"""SELECT g.fit, g.draw, g.sample_id, any_value(r.y) AS y, avg(g.value + c.centre) AS prediction
        FROM {name} g JOIN {rows} r ON r.fit = g.fit AND r.sample_id = g.sample_id JOIN ct c ON c.fit = g.fit
        WHERE g.value IS NOT NULL AND r.role <> 'train' GROUP BY g.fit, g.draw, g.sample_id"""


FULL = "SELECT -1 AS fit"


def forest_sql(params: dict, k: int) -> str:
    return f"WITH RECURSIVE {design_sql(k)}, {units_sql(one_draw(params, k), FULL)}, {grown_sql()}"


def embedding_design(spark, folder, k):
    rna, protein = _embedding_run(spark, folder)
    return plan.prepare(rna, protein, ["label"], plan.Settings(k_best=k))


def _one_forest(spark, folder, params, k):
    prepared = embedding_design(spark, folder, k)
    chosen = spark.createDataFrame([("label", 1, json.dumps(params))], "target string, draw long, params string")
    return prepared, forests.fit(prepared.design, chosen, split.SEED)


@query(
    "tree_fit",
    f"""{forest_sql(TREE, 64)} SELECT 'label' AS target, sample_id, y, round(prediction, 6) AS prediction
        FROM ({predicted_sql()})""",
)
def tree_fit(spark, folder):
    """One tree on all rows and features, grown to its end."""
    _, (_, predicted) = _one_forest(spark, folder, TREE, 64)
    return predicted.select("target", "sample_id", "y", rounded("prediction"))


@query(
    "rf_fit",
    f"""{forest_sql(FOREST, 64)} SELECT 'label' AS target, sample_id, y, round(prediction, 6) AS prediction
        FROM ({predicted_sql()})""",
)
def rf_fit(spark, folder):
    """A forest with drawn rows and features, on the rows held out."""
    _, (_, predicted) = _one_forest(spark, folder, FOREST, 64)
    return predicted.select("target", "sample_id", "y", rounded("prediction"))


@query(
    "rf_importance",
    f"""{forest_sql(FOREST, 64)},
        nodes AS (SELECT tree, path, any_value(via) AS via, sum(times)::DOUBLE AS w, sum(times * ys) AS s
                  FROM g WHERE value IS NULL AND times > 0 GROUP BY tree, path),
        gains AS (SELECT a.tree, l.via, l.s * l.s / l.w + r.s * r.s / r.w - a.s * a.s / a.w AS gain
                  FROM nodes a JOIN nodes l ON l.tree = a.tree AND l.path = a.path || '0'
                  JOIN nodes r ON r.tree = a.tree AND r.path = a.path || '1'),
        shares AS (SELECT tree, via, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share
                   FROM gains GROUP BY tree, via),
        total AS (SELECT via, sum(share) / sum(sum(share)) OVER () AS importance FROM shares GROUP BY via)
        SELECT 'label' AS target, feature, round(coalesce(importance, 0), 6) AS importance
        FROM rk LEFT JOIN total ON via = rank - 1 WHERE fit = -1""",
)
def rf_importance(spark, folder):
    prepared, (nodes, _) = _one_forest(spark, folder, FOREST, 64)
    found = plan.feature_importances(nodes, prepared.selected)
    return found.select("target", "feature", rounded("importance"))


@query(
    "model_pipeline",
    f"""{forest_sql(FOREST, 6)} SELECT 'label' AS target, sample_id, y, round(prediction, 6) AS prediction
        FROM ({predicted_sql()})""",
)
def model_pipeline(spark, folder):
    """Median filling, selection and forest fitted as one pipeline, saved, loaded and
    applied to the rows held out."""
    cells = views.embedding_cells(spark, folder)
    labels = cells.select("target", "sample_id", "y").distinct()
    placed = split.train_test_split(materialize(labels, "labels")).select("target", "sample_id", "y", "split")
    rows = materialize(models.sample_rows(placed, cells.select("target", "sample_id", "feature", "x")), "samples")
    fitted = models.forest_pipeline(6, FOREST).fit(rows.where("split = 'train'"))
    path = scratch_path(spark, "model")
    fitted.write().overwrite().save(path)
    predicted = PipelineModel.load(path).transform(rows.where("split = 'test'"))
    return predicted.select("target", "sample_id", "y", rounded("prediction"))


# ---- whole runs ---------------------------------------------------------------------


def run_sql(k: int, settings: plan.Settings) -> str:
    """Search on the folds, the best draw on all training rows, and a ridge beside it
    (in closed form on the two best features)."""
    draws = drawn_sql(settings.grid, settings.n_iter, k)
    folds = f"SELECT f AS fit FROM range({settings.folds}) t(f)"
    return f"""WITH RECURSIVE {design_sql(k)}, {units_sql(draws, folds)}, {grown_sql()},
    fold_r2 AS (SELECT draw, fit AS fold,
                       1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2
                FROM ({predicted_sql()}) GROUP BY draw, fit),
    best_draw AS (SELECT draw, params, avg(r2) AS mean_r2 FROM fold_r2 JOIN ({draws}) USING (draw)
                  GROUP BY draw, params ORDER BY round(avg(r2), 9) DESC, draw LIMIT 1),
    un2 AS (SELECT u.* , -1 AS fit FROM ({draws}) u JOIN best_draw b ON b.draw = u.draw),
    {grown_sql(units="un2", name="g2").replace("ct AS (", "ct2 AS (", 1)},
    z AS (SELECT r.role, r.sample_id, r.y, k.rank, (c.x - k.mean) / CASE WHEN k.std = 0 THEN 1 ELSE k.std END AS z
          FROM cells c JOIN rk k ON k.fit = c.fit AND k.i = c.i AND k.rank <= 2
          JOIN roles r ON r.fit = c.fit AND r.sample_id = c.sample_id WHERE c.fit = -1),
    zz AS (SELECT role, sample_id, any_value(y) AS y, max(CASE WHEN rank = 1 THEN z END) AS z1,
                  max(CASE WHEN rank = 2 THEN z END) AS z2 FROM z GROUP BY role, sample_id),
    ne AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS d, sum(z1 * (y - m)) AS u,
                  sum(z2 * (y - m)) AS v, any_value(m) AS m
           FROM zz CROSS JOIN (SELECT avg(y) AS m FROM zz WHERE role = 'train') WHERE role = 'train'),
    predictions_of AS (
        SELECT 'ridge' AS model, sample_id, y,
               m + z1 * (d * u - b * v) / (a * d - b * b) + z2 * (a * v - b * u) / (a * d - b * b) AS prediction
        FROM zz CROSS JOIN ne WHERE role = 'test'
        UNION ALL SELECT 'forest', sample_id, y, prediction FROM ({predicted_sql("g2")}))"""


def checked_run(spark, folder, targets=("LABEL", "NOPE")):
    rna, protein = _embedding_run(spark, folder)
    return plan.run_targets(rna, protein, targets, CHECKED)


@query(
    "rf_search",
    f"""{run_sql(2, CHECKED)} SELECT 'LABEL' AS target, draw, fold::INTEGER AS fold, round(r2, 6) AS r2 FROM fold_r2""",
)
def rf_search(spark, folder):
    return checked_run(spark, folder).cv_scores.select("target", "draw", "fold", rounded("r2"))


@query(
    "prediction_table",
    f"""{run_sql(2, CHECKED)}
        SELECT 'LABEL' AS target, model, sample_id, y, round(prediction, 6) AS prediction FROM predictions_of""",
)
def prediction_table(spark, folder):
    return checked_run(spark, folder).predictions.select(
        "target", "model", "sample_id", "y", rounded("prediction")
    )


METRICS_SQL = """SELECT model, round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 6) AS r2,
        round(avg(abs(y - prediction)), 6) AS mae,
        round(covar_pop(y, prediction) / nullif(stddev_pop(y) * stddev_pop(prediction), 0), 6) AS pearson
    FROM predictions_of GROUP BY model"""


@query(
    "target_metrics",
    f"""{run_sql(2, CHECKED)}, m AS ({METRICS_SQL})
        SELECT 'LABEL' AS target, (SELECT count(*) FROM embeddings) AS n_samples,
               r.r2 AS baseline_r2, r.mae AS baseline_mae, r.pearson AS baseline_pearson,
               f.r2 AS rf_r2, f.mae AS rf_mae, f.pearson AS rf_pearson,
               round(b.mean_r2, 6) AS rf_best_cv_r2, b.params AS rf_best_params, false AS target_rna_in_top50
        FROM m r JOIN m f ON r.model = 'ridge' AND f.model = 'forest' CROSS JOIN best_draw b
        UNION ALL SELECT 'NOPE', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', false""",
)
def target_metrics(spark, folder):
    found = checked_run(spark, folder).metrics
    numbers = ["baseline_r2", "baseline_mae", "baseline_pearson", "rf_r2", "rf_mae", "rf_pearson", "rf_best_cv_r2"]
    return found.withColumns({name: F.round(name, 6) for name in numbers})


SWEPT = [2, 4]


@query(
    "k_sweep_run",
    " UNION ALL ".join(
        f"""SELECT * FROM ({run_sql(k, CHECKED)} SELECT 'label' AS target, {k} AS k,
            (SELECT count(*) FROM embeddings) AS n_samples, round(mean_r2, 6) AS rf_best_cv_r2,
            params AS rf_best_params FROM best_draw)"""
        for k in SWEPT
    ),
)
def k_sweep_run(spark, folder):
    rna, protein = _embedding_run(spark, folder)
    results = plan.run_sweep(rna, protein, ["label"], SWEPT, CHECKED)
    frames = [
        r.metrics.select(
            "target", F.lit(k).alias("k"), "n_samples", rounded("rf_best_cv_r2"), "rf_best_params"
        )
        for k, r in results.items()
    ]
    return frames[0].unionByName(frames[1])


@query("full_search")
def full_search(spark, folder):
    """The default search: thirty draws of the whole grid on five folds, twenty features."""
    prepared = embedding_design(spark, folder, 20)
    draws = search.parameter_draws(spark)
    targets = prepared.rows.select("target").distinct()
    return plan.fold_scores(prepared, targets, draws, plan.Settings(k_best=20))
