from __future__ import annotations

import sys

import pytest
from conftest import rows
from pyspark.sql import functions as F

from assayframe import functions as fn


def values(frame, inputs, expression, kind="string"):
    df = frame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows(df.orderBy("i").select(expression(F.col("v"))))]


def test_feature_ids(frame):
    raw = ["ensg0001.12", " ENSP5.1 ", "ENSX1.2", None, "ENST7.3\n", "\tTP53", "A.B", "", "ENSG1.2.3"]
    assert values(frame, raw, fn.clean_feature_id) == [
        "ensg0001", "ENSP5", "ENSX1.2", "", "ENST7", "TP53", "A.B", "", "ENSG1.2.3",
    ]


def test_feature_ids_strip_any_white_space(frame):
    assert values(frame, [" ENSG1.5 ", "\r\nKRAS\t"], fn.clean_feature_id) == ["ENSG1", "KRAS"]


def test_sample_ids(frame):
    assert values(frame, [" C1\t", "C2", None], fn.clean_sample_id) == ["C1", "C2", None]


def test_camel_case(frame):
    names = ["brca", "tumor-purity v2", "__a__bC", "", "123abc-X"]
    assert values(frame, names, fn.camel_case) == ["Brca", "TumorPurityV2", "ABc", "", "123abcX"]


def test_k_from_run_dir(frame):
    dirs = ["outputs", "outputs_k10", "outputs_kx", "results", "outputs_k", "outputs_k99999999999"]
    assert values(frame, dirs, fn.k_from_run_dir) == [2000, 10, None, None, None, None]


def test_split_list(frame):
    assert values(frame, [" a, ,b,,c ", ""], fn.split_list) == [["a", "b", "c"], []]


def test_source_prefix(frame):
    df = frame(
        [
            (1, "harmonized", "brca", "transcriptomics"),
            (2, "washu", "brca", "tumor_purity"),
            (3, "washu", "brca", "proteomics"),
            (4, "mssm", "ov", "x"),
        ],
        "i int, s string, c string, t string",
    )
    got = rows(df.orderBy("i").select(fn.source_prefix(F.col("s"), F.col("c"), F.col("t"))))
    assert [g[0] for g in got] == [
        "harmonized-all_cancers-transcriptomics-",
        "washu-all_cancers-tumor_purity-",
        "washu-brca-proteomics-",
        "mssm-all_cancers-x-",
    ]


def test_header_levels(frame):
    labels = ["('raw', 'G0', 'E0')", "('A', nan, 'B')", "('meta', 'cancer_type', '')", "plain",
              "(\"5'-X\", 'E')"]
    assert values(frame, labels, fn.header_levels) == [
        ["raw", "G0", "E0"], ["A", None, "B"], ["meta", "cancer_type", ""], ["plain"], ["5'-X", "E"],
    ]


def test_digit_and_letter(frame):
    assert values(frame, ["C1", "12", "abc", "é7"], fn.has_digit_and_letter) == [
        True, False, False, True,
    ]


def test_ratio_or_zero(frame):
    df = frame([(1, 4), (1, 0)], "a int, b int")
    got = [r[0] for r in df.select(fn.ratio_or_zero(F.col("a"), F.col("b"))).collect()]
    assert got == [0.25, 0.0]


def test_null_if_nan(frame):
    assert values(frame, [1.0, float("nan"), None], fn.null_if_nan, "double") == [1.0, None, None]


def test_f_statistic_edges(frame):
    df = frame([(0, 0.5, 10), (1, 1.0, 10), (2, 0.0, 10), (3, 1.0, 2)], "i int, r2 double, n long")
    got = [r[0] for r in rows(df.orderBy("i").select(fn.f_statistic(F.col("r2"), F.col("n"))))]
    assert got == [8.0, sys.float_info.max, 0.0, 0.0]


def test_regression_expressions(frame):
    df = frame(
        [("c", 1.0, 1.0), ("c", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("e", 1.0, 1.0),
         ("f", 1.0, 2.0), ("f", 3.0, 2.0)],
        "g string, y double, p double",
    )
    got = dict(
        (r[0], r[1:])
        for r in df.groupBy("g").agg(
            fn.r_squared(F.col("y"), F.col("p")), fn.pearson(F.col("y"), F.col("p"))
        ).collect()
    )
    assert got["c"] == (1.0, None)
    assert got["d"] == (0.0, None)
    assert got["e"] == (None, None)
    assert got["f"] == (0.0, None)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_pearson_matches_numpy(frame, shift):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.normal(size=50) + shift
    p = y * 0.5 + rng.normal(size=50)
    df = frame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    got = df.agg(fn.pearson(F.col("y"), F.col("p")), fn.r_squared(F.col("y"), F.col("p"))).first()
    assert got[0] == pytest.approx(np.corrcoef(y, p)[0, 1], rel=1e-7)
    assert got[1] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-7)
