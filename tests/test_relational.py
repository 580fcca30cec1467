from __future__ import annotations

import math
import random
import statistics as st

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from assayframe.operators import align, combine, design, joins, quality, quantiles, ranking, reports, selection, split
from assayframe.schema import PROTEIN, RNA

CELL = "cohort string, sample_id string, occ long, feature_name string, database_id string, value double"
MATRIX = "cohort string, sample_id string, occ long, feature string, value double"


# ---- joins and ranking ------------------------------------------------------------


def test_checked_broadcast_is_bounded(frame):
    side = frame([(i,) for i in range(20)], "k int")
    big = joins.checked_broadcast(side, max_rows=10)
    small = joins.checked_broadcast(side, max_rows=20)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()
    assert big.count() == 20
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert small.count() == 20


def test_first_per_key(frame):
    df = frame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows(joins.first_per_key(df, ["k"], ["o"]), "k") == [("a", 1, "y"), ("b", 5, "z")]


def test_first_per_key_limits_before_the_shuffle(frame):
    df = frame([("a", 2)], "k string, o int").repartition(4)
    plan = joins.first_per_key(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_seeded_position_numbers_a_hot_group(frame):
    import hashlib

    labels = [("hot", f"s{i}") for i in range(3000)] + [("cold", f"s{i}") for i in range(7)]
    df = frame(labels, "g string, s string")
    placed = ranking.seeded_position(df, ["g"], "s", 42)
    got = {(r.g, r.s): (r.position, r.group_rows) for r in placed.collect()}
    for group, n in (("hot", 3000), ("cold", 7)):
        order = sorted((s for g, s in labels if g == group),
                       key=lambda s: (hashlib.md5(f"{s}:42".encode()).hexdigest(), s))
        assert [got[(group, s)] for s in order] == [(i, n) for i in range(1, n + 1)]


def test_sliced_position_by_slices(frame):
    df = frame([("f", 0, 1), ("f", 0, 2), ("f", 9, 1), ("g", 0, 5)], "f string, b int, o int")
    got = rows(ranking.sliced_position(df, ["f"], "b", ["o"]).select("f", "b", "o", "position"), "f", "b", "o")
    assert got == [("f", 0, 1, 1), ("f", 0, 2, 2), ("f", 9, 1, 3), ("g", 0, 5, 1)]


# ---- medians --------------------------------------------------------------------------


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_median(frame, accuracy):
    rng = random.Random(1)
    groups = {
        "hot": [rng.lognormvariate(0, 2) for _ in range(20_001)],
        "even": [1.0, 2.0, 3.0, 10.0],
        "one": [7.5],
        "two": [1.0, 2.0],
        "ties": [1.0] * 500 + [2.0] * 499,
        "half": [0.0] * 50 + [1.0] * 50,
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None)]
    df = frame(data, "g string, v double").repartition(8)
    got = dict(rows(quantiles.exact_median(df, ["g"], "v", accuracy=accuracy)))
    assert got == {g: st.median(vs) for g, vs in groups.items()}


def test_weighted_median(frame):
    df = frame([("a", 1, 3), ("a", 5, 2), ("a", 9, 1), ("b", 2, 1)], "g string, v int, n int")
    assert dict(rows(quantiles.weighted_median(df, ["g"], "v", "n"))) == {"a": 3.0, "b": 2.0}


# ---- combine ---------------------------------------------------------------------------


def test_collapse_transcripts(frame):
    df = frame(
        [("b", "S1", 0, "G", "E", 1.0), ("b", "S1", 0, "G", "E", 3.0), ("b", "S1", 0, "H", "F", 5.0),
         ("b", "S1", 0, None, "F", 5.0)],
        CELL,
    )
    got = rows(combine.collapse_transcripts(df).select("feature_name", "value"), "feature_name")
    assert got == [("G", 2.0), ("H", 5.0)]


def test_combine_needs_tables():
    with pytest.raises(ValueError):
        combine.combine_cohorts({})


def test_combine_tags_cohorts_once(frame):
    a = frame([("S1", 1.0)], "sample_id string, value double")
    b = frame([("S2", 2.0, "own")], "sample_id string, value double, cohort string")
    got = rows(combine.combine_cohorts({"a": a, "b": b}).select("sample_id", "cohort"), "sample_id")
    assert got == [("S1", "a"), ("S2", "own")]


def test_zscore_over_cohorts(frame):
    df = frame(
        [("a", "S1", 0, "G", "E", 1.0), ("a", "S2", 0, "G", "E", 2.0), ("b", "S3", 0, "G", "E", 6.0),
         ("a", "S1", 0, "C", "F", 4.0), ("b", "S3", 0, "C", "F", 4.0), ("b", "S3", 0, "L", "K", 4.0)],
        CELL,
    )
    got = {(r.sample_id, r.feature_name): r.z for r in combine.zscore(df).collect()}
    sd = st.stdev([1, 2, 6])
    assert got[("S3", "G")] == pytest.approx(3 / sd)
    assert got[("S1", "C")] is None and got[("S3", "L")] is None


def test_zscore_does_not_shuffle_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame([("a", "S1", 0, "G", "E", 1.0)], CELL).write.parquet(path)
    scored = combine.zscore(spark.read.parquet(path))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_value_blocks_and_selection(frame):
    df = frame([("S1", 1.0, 0.5)], "sample_id string, value double, z double")
    blocks = combine.value_blocks(df)
    assert rows(blocks, "value_type") == [("S1", "raw", 1.0), ("S1", "z", 0.5)]
    assert rows(align.select_value_type(blocks)) == [("S1", "raw", 1.0)]
    without = blocks.filter("value_type = 'z'").unionByName(
        frame([("S1", "meta", 0.0)], "sample_id string, value_type string, value double")
    )
    assert rows(align.select_value_type(without)) == [("S1", "z", 0.5)]


# ---- quality -----------------------------------------------------------------------------


def quality_input(frame):
    cell = "assay string, cohort string, sample_id string, occ long, label string, value double"
    cells = frame(
        [(RNA, "b", "S1", 0, "g1", 1.0), (RNA, "b", "S1", 0, "g2", 2.0), (RNA, "b", "S2", 1, "g1", 3.0),
         (PROTEIN, "b", "S1", 0, "p1", 1.0), (RNA, "solo", "S9", 0, "g1", 1.0)],
        cell,
    )
    samples = frame(
        [(RNA, "b", "S1", 0), (RNA, "b", "S2", 1), (RNA, "b", "S3", 2), (PROTEIN, "b", "S1", 0),
         (PROTEIN, "b", "S4", 1), (RNA, "solo", "S9", 0)],
        "assay string, cohort string, sample_id string, occ long",
    )
    features = frame(
        [(RNA, "b", "g1"), (RNA, "b", "g2"), (RNA, "b", "g3"), (PROTEIN, "b", "p1"), (RNA, "solo", "g1")],
        "assay string, cohort string, label string",
    )
    return cells, samples, features


def test_table_quality(frame):
    cells, samples, features = quality_input(frame)
    got = {r.assay: r for r in quality.table_quality(cells, samples, features, ["label"]).collect()}
    assert set(got) == {RNA, PROTEIN}
    rna = got[RNA]
    assert (rna.n_rows, rna.n_cols, rna.missing_count) == (3, 3, 6)
    assert rna.missing_fraction == pytest.approx(6 / 9)
    assert rna.per_sample_missing_mean == pytest.approx(np.mean([1 / 3, 2 / 3, 1]))
    assert rna.per_sample_missing_median == pytest.approx(2 / 3)
    assert rna.per_feature_missing_mean == pytest.approx(np.mean([1 / 3, 2 / 3, 1]))
    assert rna.per_feature_missing_median == pytest.approx(2 / 3)
    assert got[PROTEIN].missing_count == 1


def test_sample_overlap(frame):
    # 121 of 125 samples shared, as in a recorded report.
    data = [(RNA, "brca", f"S{i}", 0) for i in range(121)] + [
        (PROTEIN, "brca", f"S{i}", 0) for i in range(125)
    ]
    samples = frame(data + [(RNA, "solo", "S1", 0)], "assay string, cohort string, sample_id string, occ long")
    got = {r.cohort: tuple(r)[1:] for r in quality.sample_overlap(samples, RNA, PROTEIN).collect()}
    assert got["brca"] == (121, 125, 121, 1.0, 0.968)
    assert got["solo"] == (1, 0, 0, 0.0, 0.0)


def test_histogram_matches_numpy(frame):
    rng = np.random.default_rng(3)
    vals = [float(v) for v in rng.normal(size=500)]
    df = frame(
        [("r", "a", v) for v in vals] + [("r", "flat", 2.0)] * 3 + [("r", "a", None)],
        "assay string, cohort string, value double",
    )
    got = quality.value_histogram(df)
    counts = [r.n for r in got.filter("cohort = 'a'").orderBy("bin").collect()]
    assert counts == np.histogram(vals, bins=40)[0].tolist()
    flat = got.filter("cohort = 'flat'").orderBy("bin").collect()
    assert (flat[0].lo, flat[-1].hi) == (1.5, 2.5)
    assert [r.bin for r in flat if r.n] == [20] and sum(r.n for r in flat) == 3


def test_sample_values_are_capped_per_table(frame):
    data = [(RNA, c, f"S{s}", 0, f"g{g}", 1.0) for c in "ab" for s in range(12) for g in range(9)]
    cells = frame(data, "assay string, cohort string, sample_id string, occ long, label string, value double")
    got = quality.sample_values(
        cells, combine.sample_dimension(cells), combine.feature_dimension(cells, feature=["label"]),
        ["label"], max_rows=5, max_columns=4,
    )
    assert {(r.cohort, r.n) for r in got.groupBy("cohort").agg(F.count("*").alias("n")).collect()} == {
        ("a", 20), ("b", 20),
    }


# ---- alignment ---------------------------------------------------------------------------


def test_feature_matrix_averages_cleaned_names(frame):
    df = frame(
        [("a", " S1", 0, "ENSG1.1", "x", 1.0), ("a", "S1", 0, "ENSG1.2", "y", 3.0),
         ("a", "S1", 0, " ", "z", 9.0), ("a", "S1", 0, None, "z", 9.0)],
        CELL,
    )
    assert rows(align.feature_matrix(df).select("sample_id", "feature", "value")) == [("S1", "ENSG1", 2.0)]


def matrix(frame, present, cohort="a", occ=0):
    return [(cohort, s, occ, f"f{i}", float(i)) for s, n in present.items() for i in range(n)]


def test_complete_samples_boundary_and_occurrences(frame):
    data = matrix(frame, {"full": 25, "edge": 20, "below": 19}) + matrix(frame, {"twice": 3}) + matrix(
        frame, {"twice": 25}, "b"
    ) + matrix(frame, {"alone": 25})
    rna = frame(data, MATRIX)
    other = frame([("full",), ("edge",), ("below",), ("twice",)], "sample_id string")
    got = rows(align.complete_samples(rna, other), "sample_id")
    assert got == [("edge", 5, 25), ("full", 0, 25), ("twice", 0, 25)]


def test_features_without_any_value_count_as_missing(frame):
    rna = frame(matrix(frame, {"s": 8}), MATRIX)
    listed = frame([(f"f{i}",) for i in range(11)], "feature string")
    other = frame([("s",)], "sample_id string")
    assert rows(align.complete_samples(rna, other)) == [("s", 0, 8)]
    assert rows(align.complete_samples(rna, other, features=listed)) == []


def test_resolve_targets(spark, frame):
    protein = frame([("a", "S", 0, n, 1.0) for n in ("KRAS", "tp53", "Tp53", "TP53b")], MATRIX)
    asked = align.requested_targets(spark, ["KRAS", " TP53 ", "NOPE", ""])
    got = {r.target: (r.resolved, r.found) for r in align.resolve_targets(asked, protein).collect()}
    assert got == {"KRAS": ("KRAS", True), "TP53": ("tp53", True), "NOPE": (None, False)}
    with pytest.raises(ValueError):
        align.requested_targets(spark, [" "])


def test_alignment_uses_first_occurrence(spark, frame):
    rna = frame(
        [("a", "S1", 1, "f", 1.0), ("a", "S1", 0, "g", 2.0), ("b", "S1", 0, "f", 9.0), ("a", "S2", 0, "f", 3.0)],
        MATRIX,
    )
    labels = frame([("t", "S1", 5.0), ("t", "S2", 6.0), ("t", "S3", 7.0)], "target string, sample_id string, y double")
    got = rows(align.align_target(labels, rna).select("sample_id", "feature", "x", "y"), "sample_id")
    assert got == [("S1", "g", 2.0, 5.0), ("S2", "f", 3.0, 6.0)]


def test_target_values_skip_missing_and_keep_first(spark, frame):
    protein = frame(
        [("a", "S1", 0, "P", None), ("b", "S1", 0, "P", 2.0), ("c", "S1", 0, "P", 3.0), ("a", "S2", 0, "Q", None)],
        MATRIX,
    )
    resolved = align.resolve_targets(align.requested_targets(spark, ["P", "Q"]), protein)
    kept = frame([("S1",), ("S2",)], "sample_id string")
    assert rows(align.target_values(resolved, protein, kept)) == [("P", "S1", 2.0)]


@pytest.mark.parametrize(
    "rows_, columns, axis, expected",
    [
        (["C1", "C2"], ["geneA", "geneB", "geneC"], None, True),
        (["geneA", "geneB"], ["C1", "C2", "C3"], None, False),
        (["A", "B"], ["x", "y", "z"], None, True),
        (["A", "B", "C"], ["x", "y"], None, False),
        (["A", "B", "C"], ["x", "y"], "Patient_ID", True),
    ],
)
def test_orientation(frame, rows_, columns, axis, expected):
    data = [(r, i, c, j, 1.0) for i, r in enumerate(rows_) for j, c in enumerate(columns)]
    df = frame(data, "row string, row_ord int, column string, column_ord int, value double")
    got = align.infer_orientation(df, "row", "row_ord", "column", "column_ord", axis).first()
    assert got.transpose is expected
    sample = rows_[0] if expected else columns[0]
    assert sample in {r.sample_id for r in align.oriented(df, axis).collect()}


# ---- split -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 5, 13, 101])
def test_split_and_folds(frame, n):
    df = frame([("t", f"S{i}", 1.0) for i in range(n)], "target string, sample_id string, y double")
    placed = split.train_test_split(df)
    test = placed.filter("split = 'test'").count()
    assert test == math.ceil(0.2 * n)
    folds = split.assign_folds(placed)
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    train = n - test
    expected = [train // 5 + (1 if i < train % 5 else 0) for i in range(5)]
    assert [sizes.get(i, 0) for i in range(5)] == expected
    ordered = [r.fold for r in folds.orderBy("train_position").collect()]
    assert ordered == sorted(ordered)


# ---- selection ------------------------------------------------------------------------------


def dense_problem(frame, n=40, p=6, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + offset
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=n)
    mask = rng.random((n, p)) < 0.3
    mask[:, 0] = False
    x[:, p - 1] = 3.0  # constant
    data = [
        ("t", f"S{i}", float(y[i]), f"f{j}", float(x[i, j]))
        for i in range(n) for j in range(p) if not mask[i, j]
    ]
    observed = frame(data, "target string, sample_id string, y double, feature string, x double")
    labels = frame([("t", float(v)) for v in y], "target string, y double")
    filled = np.where(mask, np.nan, x)
    filled = np.where(np.isnan(filled), np.nanmedian(filled, axis=0), filled)
    return observed, labels, filled, y


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_statistics_match_dense(frame, offset):
    observed, labels, filled, y = dense_problem(frame, offset=offset)
    got = {r.feature: r for r in selection.feature_statistics(observed, labels).collect()}
    n = len(y)
    for j in range(filled.shape[1]):
        row, column = got[f"f{j}"], filled[:, j]
        assert row.median == pytest.approx(np.median(column))
        assert row["mean"] == pytest.approx(column.mean())
        assert row.std == pytest.approx(column.std(), rel=1e-6, abs=1e-12)
        if column.std() == 0:
            assert row.f_score == 0 and row.scale == 1.0
        else:
            r = np.corrcoef(column, y)[0, 1]
            assert row.r == pytest.approx(r, rel=1e-6)
            assert row.f_score == pytest.approx(r * r / (1 - r * r) * (n - 2), rel=1e-6)


def test_ranking_ties_and_limits(frame):
    df = frame([("t", "a", 1.0), ("t", "b", 1.0), ("t", "c", 2.0)], "target string, feature string, f_score double")
    ranked = selection.rank_features(df, 2)
    assert rows(ranked.select("feature", "rank"), "rank") == [("c", 1), ("b", 2)]
    assert selection.rank_features(df, 1).count() == 3
    assert selection.rank_features(df, 99).count() == 3
    swept = selection.sweep_selection(df, [2, 3])
    assert rows(swept.groupBy("k").count(), "k") == [(2, 2), (3, 3)]
    with pytest.raises(ValueError):
        selection.sweep_selection(df, [])


def test_pending_runs(frame):
    done = frame([("a", 2)], "target string, k int")
    got = rows(selection.pending_runs(frame([("a",), ("b",)], "target string"), [2, 4], done), "target", "k")
    assert got == [("a", 4), ("b", 2), ("b", 4)]


# ---- reports --------------------------------------------------------------------------------

RECORDED = [
    # Recorded runs: k, r2 of two drivers and the control, both gaps.
    (2, 0.9976695226762722, 0.983321169089724, 0.998992515060989, -0.0013229923847167813, -0.01567134597126496),
]


@pytest.mark.parametrize("k, kras, tp53, control, gap_kras, gap_tp53", RECORDED)
def test_recorded_gaps(frame, k, kras, tp53, control, gap_kras, gap_tp53):
    metrics = frame(
        [(0, "KRAS", kras), (1, "TP53", tp53), (2, "GAPDH", control), (3, "KRAS", 0.0)],
        "ord int, target string, rf_r2 double",
    )
    got = {r.driver: r.accuracy_gap_rf_r2 for r in reports.accuracy_gap(metrics, "ord").collect()}
    assert got == {"KRAS": gap_kras, "TP53": gap_tp53}


def test_gap_needs_both_values(frame):
    metrics = frame([(0, "KRAS", 0.9), (1, "GAPDH", None)], "ord int, target string, rf_r2 double")
    gaps = reports.accuracy_gap(metrics, "ord")
    assert gaps.columns == ["driver", "control", "accuracy_gap_rf_r2"] and gaps.count() == 0


def test_elbow(frame):
    metrics = frame(
        [("P", 2, 0.5), ("P", 2, 0.7), ("P", 20, 0.9), ("P", 2000, 0.9), ("P", 50, None)],
        "protein string, k int, r2 double",
    )
    assert rows(reports.metric_summary(metrics).select("k"), "k") == [(2,), (20,), (2000,)]
    got = {r.k: r for r in reports.elbow_table(metrics).collect()}
    assert set(got) == {2, 20}
    assert got[2].std == pytest.approx(st.stdev([0.5, 0.7])) and got[20].std is None
    assert got[20].std_or_zero == 0.0 and got[2].log10_k == pytest.approx(math.log10(2))


@pytest.mark.parametrize(
    "scores, knee",
    [
        ([0.1, 0.2, 0.3], None),
        ([0.5, 0.6, 0.605, 0.606, 0.607], 6),
        ([0.1, 0.2, 0.3, 0.4, 0.5], None),
        ([0.5, 0.505, None, 0.506, 0.507], None),
        ([0.9, 0.5, 0.4, 0.3], 4),
        ([0.5, None, 0.5, 0.5, 0.5, 0.5], 8),
    ],
)
def test_knee(frame, scores, knee):
    df = frame([("P", 2 * (i + 1), s) for i, s in enumerate(scores)], "protein string, k int, mean double")
    assert reports.detect_knee(df).first().knee_k == knee


def test_cv_scores_mark_first_best(frame):
    data = [("t", d, f, y, y) for d in (1, 2) for f in (0, 1) for y in (1.0, 2.0, 3.0)]
    data += [("t", 3, f, y, 2.0) for f in (0, 1) for y in (1.0, 2.0, 3.0)]
    df = frame(data, "target string, draw int, fold int, y double, prediction double")
    assert rows(reports.cv_scores(df), "draw") == [
        ("t", 1, 1.0, True), ("t", 2, 1.0, False), ("t", 3, 0.0, False),
    ]


def test_top_features_and_membership(frame):
    data = [("KRAS", f"g{i:03d}", 1.0 / (i + 1)) for i in range(60)] + [("KRAS", "KRAS", 0.001), ("A", "A", 1.0)]
    top = reports.top_features(frame(data, "target string, feature string, importance double"))
    assert top.filter("target = 'KRAS'").count() == 50
    assert dict(rows(reports.target_in_top(top))) == {"KRAS": False, "A": True}


def test_prediction_range(frame):
    df = frame([("t", 1.0, 5.0), ("t", 2.0, 0.5)], "target string, y double, prediction double")
    assert rows(reports.prediction_range(df)) == [("t", 0.5, 5.0)]


@pytest.mark.parametrize("margin", [None, 1e-6, 0.001, 0.5])
def test_medians_from_brackets_that_miss(spark, margin):
    rng = np.random.default_rng(4)
    # Most of one group lies at its ends, the middle of the other far from its neighbours.
    adversarial = [0.0] * 500 + [1e9] * 500 + [5.0, 7.0]
    groups = {"ends": adversarial, "gap": [*range(500), 10**6, *range(10**7, 10**7 + 500)], "one": [3.0]}
    groups["many"] = rng.normal(size=5_001).tolist()
    data = [(name, float(v)) for name, values in groups.items() for v in values] + [("one", None), ("none", None)]
    frame = spark.createDataFrame(data, "g string, x double").repartition(5)
    found = dict(rows(quantiles.exact_median(frame, ["g"], "x", accuracy=100, margin=margin)))
    assert found == pytest.approx({name: float(np.median(values)) for name, values in groups.items()})


@pytest.mark.parametrize("margin", [1e-6, 0.015])
def test_fold_statistics_are_those_of_the_other_folds(spark, margin):
    rng = np.random.default_rng(5)
    cells, labels = [], []
    for i in range(90):
        fold = i % 3 if i >= 15 else None
        split_ = "train" if i >= 15 else "test"
        y = float(rng.normal())
        labels.append(("t", f"s{i}", y, split_, fold))
        for j in range(4):
            # Values depend on the fold, so that its absence moves the median.
            if (i * 7 + j) % 5 and not (j == 3 and fold != 1):
                cells.append(("t", f"s{i}", y, split_, fold, f"g{j}", float(rng.normal() + 50 * (fold or 0))))
    rows_ = spark.createDataFrame(labels, "target string, sample_id string, y double, split string, fold int")
    observed = spark.createDataFrame(
        cells, "target string, sample_id string, y double, split string, fold int, feature string, x double"
    )
    merged = {
        (r.fit, r.feature): r for r in design.fit_statistics(observed, rows_, 3, margin).collect()
    }
    for fit in (-1, 0, 1, 2):
        inside = (F.col("split") == "train") & (F.lit(fit == -1) | (F.col("fold") != fit))
        alone = selection.feature_statistics(observed.where(inside), rows_.where(inside)).collect()
        assert {r.feature for r in alone} == {f for i, f in merged if i == fit}
        for r in alone:
            got = merged[fit, r.feature]
            for name in ("n", "n_observed", "median", "mean", "std", "r", "f_score"):
                assert got[name] == pytest.approx(r[name], rel=1e-9), (fit, r.feature, name)


def test_sides_are_measured_before_they_are_sent(spark):
    wide = spark.range(2_000).select("id", F.expr("repeat('x', 5000)").alias("text"))
    stored = wide.repartition(3).selectExpr("id", "text", "array(text, text) AS both")
    large = joins.checked_broadcast(stored, max_bytes=1 << 20)
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    small = joins.checked_broadcast(stored, max_bytes=1 << 27)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert small.count() == 2_000
