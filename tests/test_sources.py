from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from assayframe.plans.combining import build_tables, raw_cells, summarise_raw
from assayframe.plans.elbow import elbow_report
from assayframe.plans.quality import quality_report
from assayframe.schema import PROTEIN, RNA
from assayframe.sources import catalog, cells, matrices, metrics, scratch, sinks


def wide_file(path, samples, labels, values):
    path.parent.mkdir(parents=True, exist_ok=True)
    columns = pd.MultiIndex.from_tuples(labels) if isinstance(labels[0], tuple) else labels
    table = pd.DataFrame(values, index=pd.Index(samples, name="Patient_ID"), columns=columns)
    table.to_parquet(path)
    return table


@pytest.fixture
def raw_root(tmp_path):
    root = tmp_path / "raw"
    nan = float("nan")
    wide_file(
        root / "brca" / "transcriptomics.parquet", ["B1", "B2", "B1"],
        [("G", "T1", "E1"), ("G", "T2", "E1"), ("H", "T3", "E2")],
        [[1.0, 3.0, 5.0], [2.0, nan, nan], [9.0, 9.0, 9.0]],
    )
    wide_file(
        root / "brca" / "proteomics.parquet", ["B1", "B2"], [("P", "N1"), ("Q", "N2")],
        [[1.0, nan], [2.0, 4.0]],
    )
    wide_file(
        root / "ov" / "transcriptomics.parquet", ["O1", "O2"], [("G", "E1"), ("K", "E3")],
        [[4.0, 1.0], [6.0, nan]],
    )
    return root


def test_cohort_tables(spark, raw_root, tmp_path):
    found = cells.cohort_tables(spark, str(raw_root))
    assert rows(found.select("cohort", "assay"), "cohort", "assay") == [
        ("brca", PROTEIN), ("brca", RNA), ("ov", RNA),
    ]
    inventory = cells.cohort_inventory(found, RNA, PROTEIN)
    assert rows(inventory, "cohort") == [("brca", True, True), ("ov", True, False)]
    only = cells.cohort_inventory(found, RNA, PROTEIN, only=" ov, gbm")
    assert rows(only) == [("ov", True, False)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(RuntimeError):
        cells.cohort_tables(spark, str(tmp_path / "empty"))


def test_raw_cells(spark, raw_root):
    got = raw_cells(spark, str(raw_root)).filter("assay = 'transcriptomics'")
    brca = rows(
        got.filter("cohort = 'brca'").select(
            "sample_id", "occ", "feature_name", "transcript_id", "database_id", "value"
        ),
        "occ", "feature_name", "transcript_id",
    )
    assert brca == [
        ("B1", 0, "G", "T1", "E1", 1.0), ("B1", 0, "G", "T2", "E1", 3.0), ("B1", 0, "H", "T3", "E2", 5.0),
        ("B2", 1, "G", "T1", "E1", 2.0),
        ("B1", 2, "G", "T1", "E1", 9.0), ("B1", 2, "G", "T2", "E1", 9.0), ("B1", 2, "H", "T3", "E2", 9.0),
    ]


def test_build_tables(spark, raw_root, tmp_path):
    out = str(tmp_path / "processed")
    tables = build_tables(spark, str(raw_root), out)
    got = {(r.cohort, r.sample_id, r.occ, r.feature_name): r for r in tables["all_rna"].collect()}
    values = [got[k].value for k in (("brca", "B1", 0, "G"), ("brca", "B2", 1, "G"), ("brca", "B1", 2, "G"),
                                     ("ov", "O1", 0, "G"), ("ov", "O2", 1, "G"))]
    assert values == [2.0, 2.0, 9.0, 4.0, 6.0]
    z = (9.0 - np.mean(values)) / np.std(values, ddof=1)
    assert got[("brca", "B1", 2, "G")].z == pytest.approx(z, rel=1e-5)
    assert got[("ov", "O1", 0, "K")].z is None
    assert tables["all_protein"].count() == 3
    summary = spark.read.json(f"{out}/processed_summary.json")
    assert rows(summary.select("table", "n_rows", "n_cols"), "table") == [
        ("all_protein", 2, 2), ("all_rna", 5, 3),
    ]


def test_summary_of_raw_tables(spark, raw_root, tmp_path):
    path = str(tmp_path / "raw_summary.json")
    first = {(r.cohort, r.assay): r for r in summarise_raw(spark, str(raw_root), path).collect()}
    assert first["ov", RNA].n_rows == 2 and first["ov", RNA].n_cols == 2
    assert first["brca", RNA].n_rows == 3 and first["brca", RNA].path == f"{raw_root}/brca/{RNA}.parquet"
    # Entries of cohorts that aren't looked at stay, whatever they say.
    kind = spark.read.json(path).schema
    older = sinks.read_summary(spark, path, kind).withColumn("n_rows", F.lit(77).cast("long"))
    sinks.write_summary(older, path)
    again = {(r.cohort, r.assay): r.n_rows for r in summarise_raw(spark, str(raw_root), path, only="ov, none").collect()}
    assert again["ov", RNA] == 2 and again["brca", RNA] == 77 and again.keys() == first.keys()


def test_quality_report(spark, raw_root, tmp_path):
    report = quality_report(spark, str(raw_root), str(tmp_path / "qc"))
    got = {r.assay: r for r in report.tables.collect()}
    assert set(got) == {RNA, PROTEIN}
    assert (got[RNA].n_rows, got[RNA].n_cols, got[RNA].missing_count) == (3, 3, 2)
    assert got[RNA].per_sample_missing_mean == pytest.approx((2 / 3) / 3)
    assert got[PROTEIN].per_feature_missing_median == 0.25
    assert rows(report.overlap) == [("brca", 2, 2, 2, 1.0, 1.0)]
    assert report.histogram.count() == 80


def test_wide_reader_splits_columns_and_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(30, 50))
    values[rng.random(values.shape) < 0.2] = np.nan
    table = pd.DataFrame(values, columns=[f"g.{i}" for i in range(50)])
    table.insert(0, "Patient_ID", [f"S{i}" for i in range(30)])
    table["note"] = "text"
    table["cancer_type"] = ["a"] * 15 + ["b"] * 15
    path = str(tmp_path / "wide.parquet")
    table.to_parquet(path, row_group_size=7, index=False)
    files = spark.createDataFrame([(f"file:{path}",)], "path string")
    got = matrices.read_wide(spark, files, "Patient_ID", "cancer_type", columns_per_task=8, tasks=4)
    found = {(r.occ, r.label): (r.sample_id, r.cohort, r.value) for r in got.collect()}
    expected = {
        (i, f"g.{j}"): (f"S{i}", "a" if i < 15 else "b", values[i, j])
        for i in range(30) for j in range(50) if not np.isnan(values[i, j])
    }
    assert found == expected
    assert matrices.wide_samples(files, "Patient_ID").count() == 30
    assert matrices.wide_features(files, "Patient_ID").count() == 50


def test_header_depth(frame):
    df = frame([("('meta', 'cancer_type', '')",), ("('z', 'G', 'E')",), ("('G', 'T', 'E')",), ("('G', 'E')",)], "label string")
    got = rows(matrices.with_header(df).select("value_type", "feature_name", "transcript_id", "database_id"))
    assert got == [("meta", "cancer_type", None, ""), ("z", "G", None, "E"), (None, "G", "T", "E"), (None, "G", None, "E")]
    for bad in ("plain", "('a', 'b', 'c', 'd')"):
        with pytest.raises(Exception, match="unsupported header"):
            matrices.with_header(frame([(bad,)], "label string")).collect()


def test_long_columns():
    assert matrices.long_columns(["Patient_ID", "ID", "Protein", "Intensity"]) == {
        "sample_id": "Patient_ID", "feature": "Protein", "value": "Intensity",
    }
    assert matrices.long_columns(["sample", "sample_id", "gene", "value"])["sample_id"] == "sample"
    assert matrices.long_columns(["sample", "value"]) is None


def test_load_matrix(spark, frame):
    long = frame([("S1", "g", 1.0), ("S1", "g", 3.0), ("S2", "g", float("nan"))], "Sample string, Gene string, Expression double")
    assert rows(matrices.load_matrix(long), "sample_id") == [("S1", "g", 2.0), ("S2", "g", None)]
    wide = frame([("S1", 1.0, None, "x"), ("S2", 2.0, 3.0, "y")], "Patient_ID string, `g.x` double, h double, note string")
    expected = [("S1", "g.x", 1.0), ("S2", "g.x", 2.0), ("S2", "h", 3.0)]
    assert sorted(rows(matrices.load_matrix(wide, "Patient_ID"))) == expected
    turned = frame([("ga", 1.0, 2.0), ("gb", None, 3.0)], "name string, S1 double, S2 double")
    assert sorted(rows(matrices.load_matrix(turned, "name"))) == [
        ("S1", "ga", 1.0), ("S2", "ga", 2.0), ("S2", "gb", 3.0),
    ]
    with pytest.raises(ValueError):
        matrices.load_matrix(wide)


def test_numeric_columns(frame):
    assert matrices.numeric_columns(frame([("a", 1)], "s string, n int")) == ["n"]
    assert matrices.numeric_columns(frame([("a", "b")], "s string, t string")) == ["s", "t"]


def test_cells_roundtrip_and_pruning(spark, frame, tmp_path):
    data = frame([(RNA, "a", "S1", 0, "G", "E", 1.5), (RNA, "b", "S2", 0, "H", "E", float("nan"))],
                 "assay string, cohort string, sample_id string, occ long, feature_name string, database_id string, value double")
    path = str(tmp_path / "cells")
    cells.write_cells(cells.conform(data), path)
    back = cells.read_cells(spark, path)
    assert rows(back.select("cohort", "feature_name", "value")) == [("a", "G", 1.5)]
    pruned = back.filter("cohort = 'a' AND feature_name = 'G'").select("value")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cohort" in plan and "EqualTo(feature_name,G)" in plan


def test_materialize(spark, frame):
    df = frame([("01", 1), ("x", 2)], "target string, v int")
    back = scratch.materialize(df, "test", ["target"])
    assert rows(back, "v") == [("01", 1), ("x", 2)] and back.columns == ["target", "v"]
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- metrics files ---------------------------------------------------------------------------


@pytest.fixture
def run_folders(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("outputs_k10/metrics.csv",
        "target,n_samples,rf_r2,rf_mae,rf_best_params\n"
        'KRAS,9,0.5,0.1,"{""a"": 1, ""b"": null}"\n'
        " ,9,0.6,0.2,\n"
        " TP53 ,9,,,\n")
    put("outputs_k10/deep/Metrics_old.CSV", "mae,r2,target,rmse\n0.3,0.7,KRAS,5\n")
    put("outputs_k10/notes.csv", "target,r2\nX,1\n")
    put("outputs/metrics.csv", "name,r2\nKRAS,0.1\n")
    put("outputs/metrics.json", json.dumps({"results": [
        {"target": "KRAS", "rf_r2": 0.9, "rmse": 2}, 7, {"target": "P", "rf_r2": None, "r2": 0.4}, {"target": "Q", "r2": 0.3, "mae": 0.2},
        {"r2": 1.0},
    ]}))
    put("outputs_k4/metrics.json", json.dumps([{"target": "KRAS", "r2": 0.25}]))
    put("outputs_k6/metrics.json", "{broken")
    put("outputs_kx/metrics.csv", "target,r2\nKRAS,0.1\n")
    put("outputs_k12/metrics.csv/part-0000.csv", "target,rf_r2\nKRAS,0.75\n")
    return tmp_path


def test_read_metrics(spark, run_folders):
    got = metrics.read_metrics(spark, [f"{run_folders}/outputs*"])
    found = rows(got.select("k", "protein", "iteration", "r2", "mae", "rmse"), "k", "protein", "iteration", "r2")
    assert found == [
        (4, "KRAS", 1, 0.25, None, None),
        (10, "KRAS", 1, 0.5, 0.1, None),
        (10, "KRAS", 1, 0.7, 0.3, None),
        (10, "TP53", 3, None, None, None),
        (12, "KRAS", 1, 0.75, None, None),
        (2000, "KRAS", 1, 0.9, None, 2.0),
        (2000, "P", 3, None, None, None),
        (2000, "Q", 4, 0.3, 0.2, None),
    ]


def test_read_metrics_of_any_header(spark, tmp_path):
    """Files of many different headers, rows too short and too long, blank lines, repeated
    names, quoted names and separators; the ordinal counts blank targets."""
    import csv
    import io

    columns = ["target", "rf_r2", "r2", "rf_mae", "mae", "n, all", 'x"y']
    expected = []
    for i in range(30):
        header = columns[i % 7 :] + columns[: i % 7] + ["target"] * (i % 2) + ["z"] * (i % 5)
        text = io.StringIO()
        table = csv.writer(text, lineterminator="\r\n" if i % 3 == 0 else "\n")
        if i % 4 == 0:
            text.write("  \n")
        table.writerow(header)
        for row in range(1, 6):
            # The first column of a name counts.
            cells = {"rf_r2": f"0.{row}", "rf_mae": f"{i}.5", "n, all": "a, b", 'x"y': 'q"'}
            cells["target"] = " " if row == 2 else f"T{row}, {i}"
            line = [cells.get(name, "") for name in header]
            for extra in range(len(columns), len(header)):
                line[extra] = "other"
            table.writerow(line + ["more"] * (3 if row == 3 else 0))
            if row == 4:
                text.write("\n")
            if row != 2:
                expected.append((i + 1, row, f"T{row}, {i}", row / 10, i + 0.5))
        path = tmp_path / f"outputs_k{i + 1}" / "sub+dir %20 é" / f"METRICS{i}.csv"
        path.parent.mkdir(parents=True)
        path.write_bytes(text.getvalue().encode())
    (tmp_path / "outputs_k1" / "metrics.csv").write_text("")
    (tmp_path / "outputs_k2" / "metrics.csv").write_text("r2\n1\n")
    (tmp_path / "outputs_k3" / "metrics_short.csv").write_text("r2,target\n1,A\n2\n")
    got = metrics.read_metrics(spark, [f"{tmp_path}/outputs*/", f"{tmp_path}/nothing*", f"{tmp_path}/outputs_k5"])
    found = rows(got.select("k", "iteration", "protein", "r2", "mae"), "k", "iteration", "protein")
    assert found == sorted([*expected, (3, 1, "A", 1.0, None)])


def test_read_metrics_needs_files(spark, tmp_path):
    (tmp_path / "outputs").mkdir()
    (tmp_path / "outputs" / "x.csv").write_text("target,r2\nA,1\n")
    with pytest.raises(RuntimeError):
        metrics.read_metrics(spark, [f"{tmp_path}/outputs*"])
    with pytest.raises(ValueError):
        metrics.read_metrics(spark, ["outputs*"])


def test_elbow_report(spark, run_folders, tmp_path):
    report = elbow_report(spark, [f"{run_folders}/outputs*"], out=str(tmp_path / "elbow"))
    assert rows(report.elbow.filter("protein = 'KRAS'").select("k"), "k") == [(4,), (10,), (12,)]
    knees = dict(rows(report.knees))
    assert knees["Q"] is None
    assert spark.read.option("header", True).csv(str(tmp_path / "elbow" / "summary.csv")).count() == 5


# ---- catalog, summaries, events ------------------------------------------------------------------


def test_sources(frame):
    lists = frame(
        [("brca", "transcriptomics", 2, ["late"]), ("brca", "transcriptomics", 1, ["bcm", "broad", "harmonized"]),
         ("ov", "proteomics", 1, ["umich", "mssm"])],
        "cohort string, data_type string, list_ord int, sources array<string>",
    )
    index = frame(
        [("bcm-brca-transcriptomics-a.tsv",), ("broad-brca-transcriptomicsX-a.tsv",),
         ("harmonized-all_cancers-transcriptomics-x-y.gz",), ("umich-brca-proteomics-1",), ("plain",)],
        "filename string",
    )
    got = catalog.available_sources(catalog.listed_sources(lists), index)
    assert rows(got.select("cohort", "source"), "cohort", "priority") == [
        ("brca", "bcm"), ("brca", "harmonized"), ("ov", "umich"), ("ov", "mssm"),
    ]


def test_source_prefix_of_a_dashed_source(frame):
    candidates = frame([("a-b", "t", 0, "x-y")], "cohort string, data_type string, priority int, source string")
    index = frame([("x-y-a-b-t-1",), ("x-y-a-b-t",)], "filename string")
    assert catalog.available_sources(candidates.unionByName(
        frame([("a-b", "t", 1, "none")], "cohort string, data_type string, priority int, source string")
    ), index).count() == 1


def test_first_available(frame):
    attempts = frame(
        [("a", "t", "m1", 0, "s1", 0, False), ("a", "t", "m1", 0, "s2", 1, True), ("a", "t", "m2", 1, "s1", 0, True)],
        "cohort string, data_type string, method string, method_priority int, source string, source_priority int, available boolean",
    )
    assert rows(catalog.first_available(attempts)) == [("a", "t", "m1", "s2")]


def test_summary_upsert_roundtrip(spark, frame, tmp_path):
    schema = "cohort string, n long"
    kind = frame([], schema).schema
    assert sinks.read_summary(spark, str(tmp_path / "absent"), kind).count() == 0
    (tmp_path / "broken.json").write_text("{not json")
    assert sinks.read_summary(spark, str(tmp_path / "broken.json"), kind).count() == 0
    path = str(tmp_path / "summary.json")
    sinks.write_summary(frame([("a", 1), ("b", 2)], schema), path)
    merged = sinks.upsert_summary(sinks.read_summary(spark, path, kind), frame([("b", 9)], schema), ["cohort"])
    sinks.write_summary(merged, path)
    assert rows(sinks.read_summary(spark, path, kind), "cohort") == [("a", 1), ("b", 9)]


def test_a_summary_survives_a_failure_in_between(spark, frame, tmp_path, monkeypatch):
    schema, path = "cohort string, n long", str(tmp_path / "summary.json")
    kind = frame([], schema).schema
    sinks.write_summary(frame([("a", 1)], schema), path)
    broken = frame([("a", 2)], schema).select("cohort", F.raise_error(F.lit("lost")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_summary(broken, path)
    assert rows(sinks.read_summary(spark, path, kind)) == [("a", 1)]
    # Written in full, and the old one gone: the new one counts.
    sinks.write_summary(frame([("b", 3)], schema), str(tmp_path / "other"))
    (tmp_path / "other").rename(tmp_path / "summary.json.next")
    assert rows(sinks.read_summary(spark, path, kind)) == [("a", 1)]
    (tmp_path / "summary.json").rename(tmp_path / "away")
    assert rows(sinks.read_summary(spark, path, kind)) == [("b", 3)]
    merged = sinks.upsert_summary(sinks.read_summary(spark, path, kind), frame([("c", 4)], schema), ["cohort"])
    sinks.write_summary(merged, path)
    assert rows(sinks.read_summary(spark, path, kind), "cohort") == [("b", 3), ("c", 4)]
    assert not (tmp_path / "summary.json.next").exists()


def test_summary_documents(frame):
    df = frame([("brca", "proteomics", 5), ("brca", "transcriptomics", 4)], "cohort string, assay string, rows long")
    (row,) = sinks.summary_documents(df, "cohort", ["assay"]).collect()
    assert json.loads(row.document) == {"proteomics": {"rows": 5}, "transcriptomics": {"rows": 4}}


def test_csv_of_an_empty_report_keeps_its_header(spark, frame, tmp_path):
    path = str(tmp_path / "gap.csv")
    sinks.write_csv(frame([], "driver string, gap double"), path)
    assert spark.read.option("header", True).csv(path).columns == ["driver", "gap"]
