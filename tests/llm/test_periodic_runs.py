import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayframe.llm import periodic_runs as periodic
from assayframe.llm.queries import QUERIES, with_periods

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute_runs(words, least_words=6, least_periods=4):
    """Every period tried at every place; a stretch counts for its smallest one."""
    found = {}
    for period in range(1, len(words) // least_periods + 1):
        at = period
        while at < len(words):
            if words[at] != words[at - period]:
                at += 1
                continue
            stop = at
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            if stop - at + period >= max(least_words, least_periods * period):
                found.setdefault((at - period, stop), period)
            at = stop
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def altered(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    words = altered(doc_id, words_of(text))
    found = brute_runs(words)
    dropped = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, milli, hexed(lines), hexed(left))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 9), st.integers(2, 5))
def test_runs_of_any_words(words, least_words, least_periods):
    assert periodic.runs(words, least_words, least_periods) == brute_runs(words, least_words, least_periods)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(2, 12), st.integers(0, 6), st.integers(0, 40))
def test_runs_of_repeated_words(period, times, more, hole):
    words = period * times + period[:more]
    words = [9, *words[:hole], 8, *words[hole:], 9, *words]
    assert periodic.runs(words, 2, 2) == brute_runs(words, 2, 2)


def test_squares_have_equal_halves_and_no_primitive_one_is_missing():
    random.seed(3)
    words = [random.randrange(2) for _ in range(300)]
    told = set(periodic.squares(words))
    for end, q in told:
        assert words[end - 2 * q + 1 : end - q + 1] == words[end - q + 1 : end + 1]
    for start, length, q in brute_runs(words, 2, 2):
        assert {(start + 2 * q - 1 + i, q) for i in range(length - 2 * q + 1)} <= told


def test_a_long_text():
    words = list(range(5_000)) * 5 + [7] * 30_000 + list(range(100, 130)) * 400
    random.seed(4)
    words += [random.randrange(2_000) for _ in range(100_000)]
    found = periodic.runs(words)
    assert {(0, 25_000, 5_000), (25_000, 30_000, 1), (55_000, 12_000, 30)} <= set(found)
    for start, length, q in found:
        assert words[start : start + length - q] == words[start + q : start + length]


TEXTS = [
    None,
    "",
    " \n\t\x0b\x0c\r",
    "  a  a a\na\ta a ",
    "a a a a a",
    "é é é é é é É É",
    "x y x y x y x y x y z",
    "a a a a a a b a a a a a a b a a a a a a b a a a a a a b a a",
    "nbsp\xa0is no white space   neither",
    "word " * 40_000 + "end",
    " ".join(f"w{i % 700}" for i in range(9_000)),
    "\x1f \x85 a\x00b a\x00b a\x00b a\x00b a\x00b a\x00b",
]


def test_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[6]), (6, TEXTS[6]), (6, TEXTS[6])]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("runs", "collapsed", "n_words", "part"):
        docs = docs.withColumn(name, F.lit(1))
    found = periodic.periodic_runs(docs)
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr
    )
    expected = []
    for doc_id, text in rows:
        words = words_of(text)
        own = brute_runs(words) if len(words) < 10_000 else periodic.runs([w == "end" for w in words])
        gone = {i for a, size, q in own for i in range(a + q, a + size)}
        expected.append((doc_id, len(words), own, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(expected, key=repr)


def test_small_slices_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), SCHEMA).coalesce(1)
    whole = sorted(periodic.periodic_runs(docs).collect())
    monkeypatch.setattr(periodic, "BATCH_BYTES", 10)
    assert sorted(periodic.periodic_runs(docs).collect()) == whole


def test_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_of_altered_texts(spark):
    rows = [(i, t) for i in range(60) for t in ("p q r s t u v w x y", None, "", " one\n")] + [(None, "a b c d")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, words_of(r.text)) for r in with_periods(docs).collect()), key=repr)
    assert got == sorted(((i, altered(i, words_of(t))) for i, t in rows), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_query_against_brute_force(spark, table):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert got.keys() == table.keys()
    for doc_id, text in table.items():
        if len(words_of(text)) < 4_000:
            assert got[doc_id] == brute_row(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) > 10
