import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm import lm_scoring
from assayframe.llm.common import folded_words


def tokens(text):
    return [*folded_words(text), b""]


def plain_base(docs, learn):
    counts = {}
    for text in learn:
        for t in tokens(text):
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    found = {}
    for i, text in docs:
        own = tokens(text)
        base = sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        found[i] = (len(own), sum(t in counts for t in own), n, base)
    return found


def check(spark, docs, learn):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm_scoring.score(frame, spark.createDataFrame([(t,) for t in learn], "text string")).collect()
    plain = plain_base(docs, learn)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == plain[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(plain[r["doc_id"]][3], rel=1e-9, abs=1e-9)
        assert r["score"] <= 1e-4
    return {r["doc_id"]: r["score"] for r in got}


@pytest.fixture
def few_at_hand(monkeypatch):
    monkeypatch.setattr(lm_scoring, "DICTIONARY", 40)


def test_base_with_counts_at_hand_and_joined(spark, few_at_hand):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    docs = [(r["doc_id"], r["text"]) for r in rows]
    docs += [(1000, None), (1001, ""), (1002, "  x\ty "), (1003, docs[0][1]), (1004, "Neverseen neverseen")]
    check(spark, docs, [t for i, t in docs if i % 3])


def test_nothing_to_learn_from_and_no_rows(spark):
    scores = check(spark, [(1, "a b"), (2, None)], [])
    assert scores[2] == pytest.approx(-math.log10(lm_scoring.UNITS), abs=0.05)
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(frame, frame).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = lm_scoring.token_counts(docs).cache()
    words = lm_scoring.vocabulary(counts)
    vocab = spark.sparkContext.broadcast(words)
    model = lm_scoring.train(docs, vocab, words.unit_share)
    first, second, norm = lm_scoring.normalised(model)
    random = np.random.default_rng(0)
    for u1, u2 in random.integers(0, lm_scoring.UNITS, (20, 2)):
        total = np.exp(first[u1] + second[u2] - norm[u1, u2]).sum()
        assert total == pytest.approx(1, rel=1e-9)
        plain = (model.R[u1] @ model.C1 + model.R[u2] @ model.C2) @ model.Q.T + model.b
        assert norm[u1, u2] == pytest.approx(np.log(np.exp(plain).sum()), rel=1e-9)
    # In each bucket its words and one unseen word share all of it.
    common = set(sorted(words.rows, key=words.rows.get)[: lm_scoring.COMMON_WORDS])
    shares = np.zeros(lm_scoring.UNITS)
    for r in counts.collect():
        word = bytes(r["word"])
        if word and word not in common:
            bucket = lm_scoring.bucket_of(word)
            shares[bucket] += (r["c"] + 0.1) / np.exp(words.bucket_log_mass[bucket])
    shares += np.where(np.arange(lm_scoring.UNITS) > lm_scoring.COMMON_WORDS, 0.1 / np.exp(words.bucket_log_mass), 0)
    assert shares[lm_scoring.COMMON_WORDS + 1 :] == pytest.approx(1)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 10 == 0
    got = lm_scoring.score(docs.where(held), docs.where(~held))
    r = got.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r["model"] > r["base"]


def test_gradient_of_the_trainer():
    share = np.full(lm_scoring.UNITS, 1 / lm_scoring.UNITS)
    model = lm_scoring.untrained(share)
    trainer = lm_scoring.Trainer(model, share, 1)
    random = np.random.default_rng(5)
    # A unit that always follows another becomes likely after it.
    u1 = random.integers(0, 50, 4096)
    before = lm_scoring.normalised(model)
    for _ in range(60):
        trainer.step(np.zeros_like(u1), u1, u1 + 100)
    after = lm_scoring.normalised(model)
    gain = [
        (t[0][u, u + 100] + t[1][0, u + 100] - t[2][u, 0]) for t in (before, after) for u in range(50)
    ]
    assert np.mean(gain[50:]) > np.mean(gain[:50]) + 1


def test_buckets_agree_with_sql(spark):
    words = [b"a", b"abcd", "éü".encode(), b"\xf0\x9f\x98\x80x"]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    got = [r[0] for r in frame.select(F.crc32(F.substring("word", 1, 3)) % lm_scoring.BUCKETS).collect()]
    assert got == [zlib.crc32(w[:3]) % lm_scoring.BUCKETS for w in words]
