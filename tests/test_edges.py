"""Cases at the edges: missing ids, empty features, repeated labels, odd paths, reruns."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from assayframe.operators import align, combine, reports
from assayframe.plans import modelling as plan
from assayframe.plans.combining import build_tables, raw_cells
from assayframe.schema import PROTEIN, RNA
from assayframe.sources import cells, metrics, sinks
from test_models import GRID, problem


def test_zscore_keeps_features_without_an_id(spark):
    rows = [("c", f"s{i}", 0, "g", None, float(i)) for i in range(2)]
    rows += [("c", f"s{i}", 0, "g", "id", 10.0 * i) for i in range(2)]
    schema = "cohort string, sample_id string, occ long, feature_name string, database_id string, value double"
    got = combine.zscore(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4
    assert sorted(round(r["z"], 6) for r in got if r["database_id"] is None) == [-0.707107, 0.707107]


def test_features_without_a_value_count_as_missing(spark):
    rows = [("c", "a", 0, f"g{i}", 1.0) for i in range(5)] + [("c", "b", 0, f"g{i}", 1.0) for i in range(4)]
    schema = "cohort string, sample_id string, occ long, feature string, value double"
    matrix = spark.createDataFrame(rows, schema)
    listed = spark.createDataFrame([(f"g{i}",) for i in range(6)], "feature string")
    kept = lambda **more: {r["sample_id"] for r in align.complete_samples(matrix, matrix, **more).collect()}
    assert kept() == {"a", "b"}
    assert kept(features=listed) == {"a"}


def test_orientation_counts_rows_with_one_label(spark):
    rows = [("x", i, f"y{j}", j, 1.0) for i in range(3) for j in range(2)]
    matrix = spark.createDataFrame(rows, "row string, row_ord long, column string, column_ord long, value double")
    found = align.infer_orientation(matrix, "row", "row_ord", "column", "column_ord").first()
    assert (found["n_rows"], found["n_cols"]) == (3, 2)


def test_only_in_any_case(spark):
    tables = spark.createDataFrame([("brca", RNA), ("BRCA", PROTEIN), ("luad", RNA)], "cohort string, assay string")
    got = cells.cohort_inventory(tables, RNA, PROTEIN, only=" BRCA ,").collect()
    assert [tuple(r) for r in got] == [("brca", True, True)]


def test_part_files_below_a_folder_with_blanks(spark, tmp_path):
    root = tmp_path / "raw +%20 data"
    (root / "one").mkdir(parents=True)
    wide = pd.DataFrame({"id": ["a", "a", "b"], "('g', 'x')": [1.0, 2.0, 3.0]})
    wide.to_parquet(root / "one" / "transcriptomics.parquet", index=False)
    parts = root / "two" / "transcriptomics.parquet"
    parts.mkdir(parents=True)
    wide.to_parquet(parts / "part-0.parquet", index=False)
    wide.to_parquet(parts / "part-1.parquet", index=False)
    got = raw_cells(spark, str(root), index="id").collect()
    by = {c: [r for r in got if r["cohort"] == c] for c in ("one", "two")}
    assert len(by["one"]) == 3 and len(by["two"]) == 6
    assert len({r["occ"] for r in by["two"]}) == 6
    assert {r["occ"] for r in by["one"]} == {0, 1, 2}


def test_tables_are_built_twice_into_one_folder(spark, tmp_path):
    for cohort in ("one", "two"):
        (tmp_path / "raw" / cohort).mkdir(parents=True)
        for n, assay in enumerate((RNA, PROTEIN)):
            wide = pd.DataFrame({"id": ["a", "b"], "('g', 'x')": [1.0 + n, 2.0]})
            wide.to_parquet(tmp_path / "raw" / cohort / f"{assay}.parquet", index=False)
    for _ in range(2):
        tables = build_tables(spark, str(tmp_path / "raw"), str(tmp_path / "out"), index="id")
        assert tables["all_rna"].count() == 4


def test_metrics_with_odd_names_and_roots_without_a_match(spark, tmp_path):
    run = tmp_path / "my runs" / "outputs_k4"
    run.mkdir(parents=True)
    (run / "metrics.csV").write_text("target,rf_r2\nA,0.5\n ,0.1\nB,0.25\n")
    (run / "metrics_more.JSON").write_text('{"results": [{"target": "C", "r2": 1.0}]}')
    roots = [str(tmp_path / "absent*"), str(tmp_path / "my runs" / "outputs*")]
    got = {(r["protein"], r["iteration"], r["r2"], r["k"]) for r in metrics.read_metrics(spark, roots).collect()}
    assert got == {("A", 1, 0.5, 4), ("B", 3, 0.25, 4), ("C", 1, 1.0, 4)}
    with pytest.raises(RuntimeError):
        metrics.read_metrics(spark, roots[:1])


def test_a_missing_fold_leaves_no_mean(spark):
    scores = spark.createDataFrame(
        [("t", 1, 0, 0.9), ("t", 1, 1, None), ("t", 2, 0, 0.5), ("t", 2, 1, 0.5)],
        "target string, draw long, fold int, r2 double",
    )
    means = {r["draw"]: r["mean_r2"] for r in reports.mean_scores(scores, ["target", "draw"]).collect()}
    assert means == {1: None, 2: 0.5}
    assert plan.best_draws(scores).first()["draw"] == 2


def test_csv_is_replaced(spark, tmp_path):
    for n in (2, 1):
        sinks.write_csv(spark.range(n), str(tmp_path / "r.csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r.csv")).count() == 1


def test_a_sweep_goes_on_where_it_stopped(spark, tmp_path):
    rna, protein = problem(spark, n=30, p=4)
    settings = plan.Settings(k_best=4, n_iter=1, grid=GRID, folds=2)
    out = str(tmp_path)
    assert set(plan.run_sweep(rna, protein, ["KRAS"], [2], settings, out)) == {2}
    assert set(plan.run_sweep(rna, protein, ["KRAS"], [2, 3], settings, out)) == {3}
    assert plan.run_sweep(rna, protein, ["KRAS"], [2, 3], settings, out) == {}
    assert os.path.isdir(f"{out}/outputs_k3/metrics.csv")


def test_tables_can_be_freed(spark):
    # A session of its own name for the folder, so that no other test's tables go.
    from unittest import mock

    from assayframe.sources import scratch

    with mock.patch.object(scratch, "_own_folder", lambda s: f"{scratch.shared_folder(s)}/freed"):
        scratch.materialize(spark.range(3), "some")
        folder = f"{scratch.shared_folder(spark).removeprefix('file:')}/freed"
        assert os.listdir(folder)
        scratch.free_tables(spark)
        assert not os.path.exists(folder)
