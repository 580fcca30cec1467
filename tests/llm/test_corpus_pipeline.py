"""The pipeline's stages, each held against brute force on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayframe.llm import language_id
from assayframe.llm.simhash_dedup import fingerprint, shingle_hashes
from assayframe.llm.tokens import WordEncoder, read_definition

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(
        [(9000, None, "en", "s", 0), (9001, "12 34 !", "en", "s", 7), (9002, "", None, None, 0)], docs.schema
    )
    kept = [docs.union(extra)]
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, kept[-1], FOLDER).cache()
        frame.count()
        kept.append(frame)
    return kept


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontamination", "packing",
    ]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[1:-1])


def test_language(stages):
    gone = ids(stages[0]) - ids(stages[1])
    assert {9000, 9001, 9002} <= gone
    assert language_id.UNDETERMINED not in {r["lang"] for r in stages[1].collect()}
    assert len(gone) <= 5


def prints_of(rows):
    return np.array([fingerprint(shingle_hashes(r["text"], 3)) for r in rows], dtype=np.int64).view(np.uint64)


def survivors(rows):
    """Positions of the rows that stay, by all pairs of fingerprints."""
    prints, root = prints_of(rows), list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    for place, a in enumerate(order):
        for b in order[place + 1 :]:
            if root[a] != root[b] and np.bitwise_count(prints[a] ^ prints[b]) <= 3:
                low, high = sorted((root[a], root[b]), key=order.index)
                root = [low if r == high else r for r in root]
    return {i for i in range(len(rows)) if root[i] == i}


def test_one_of_each_group_of_copies_stays(stages):
    before = sorted(stages[1].collect(), key=lambda r: r["doc_id"])
    assert ids(stages[2]) == {before[i]["doc_id"] for i in survivors(before)}


def test_copies_by_row_not_by_id(spark):
    text = "one two three four five six seven eight nine ten"
    other = "a wholly different text that shares no run of words with it"
    rows = [
        (5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, other, "en", "s", 1), (3, text, "en", "s", 1),
        (None, text, "en", "s", 1), (None, "nobody has this one but a row without id", None, None, None),
        (None, "nobody has this one but a row without id", None, None, None), (7, "", "en", "s", 0),
        (8, None, "en", "s", 0), (9, other + " 2", "en", "s", 1), (9, other + " 2", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("key", F.lit("x")).withColumn("component_id", F.lit(1))
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    listed = [dict(doc_id=r[0], text=r[1]) for r in rows]
    expected = sorted([(rows[i][0], rows[i][1]) for i in survivors(listed)], key=repr)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == expected
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), FOLDER).collect() == []


def test_no_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_long_run_is_left_twice(stages):
    seen = {}
    for r in stages[3].collect():
        words = r["text"].lower().split()
        assert words and r["n_chars"] == len(r["text"])
        for i in range(len(words) - 49):
            assert seen.setdefault(tuple(words[i : i + 50]), r["doc_id"]) == r["doc_id"]
    # Nothing but repeated passages went.
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not Counter(r["text"].split()) - Counter(before[r["doc_id"]].split())


def test_no_benchmark_passage_is_left(spark, stages):
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in stages[3].collect()}
    leaks = {i for i, t in texts.items() if any(f" {' '.join(x)} " in f" {t} " for x in items)}
    assert not leaks & ids(stages[4])
    assert ids(stages[4]) >= ids(stages[3]) - leaks - set(
        i for i, t in texts.items() if any(len(shingles(t) & shingles(" ".join(x))) >= 0.6 * len(x) for x in items)
    )


def test_every_id_is_packed(stages):
    encoder = WordEncoder(read_definition(corpus_pipeline.TOKENIZER))
    got = {}
    for r in sorted(stages[5].collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    wanted = {
        r["doc_id"]: [*np.frombuffer(encoder.encode(r["text"]), encoder.dtype).tolist(), corpus_pipeline.END_ID]
        for r in stages[4].collect()
    }
    assert got == wanted
