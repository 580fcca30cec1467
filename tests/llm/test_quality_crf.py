import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayframe.llm import quality_crf as crf
from assayframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
GOOD = "The quiet river runs past the old mill.\nNobody knows who built it, or when."
BAD = "buy buy buy buy buy buy buy buy buy\nBUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"


def brute_marginals(good, initial, moves):
    """All labellings of one chain."""
    weights = {}
    for states in itertools.product((0, 1), repeat=len(good)):
        energy = initial[states[0]] + sum(g for g, s in zip(good, states) if s)
        energy += sum(moves[a, b] for a, b in zip(states, states[1:]))
        weights[states] = np.exp(energy)
    total = sum(weights.values())
    p = [sum(w for s, w in weights.items() if s[i]) / total for i in range(len(good))]
    pairs = np.zeros((2, 2))
    for states, w in weights.items():
        for a, b in zip(states, states[1:]):
            pairs[a, b] += w / total
    return p, pairs, np.log(total)


def test_forward_backward_against_all_labellings():
    random = np.random.default_rng(5)
    bounds = np.array([0, 3, 3, 4, 10, 12])
    good, initial, moves = random.normal(size=12), random.normal(size=2), random.normal(size=(2, 2))
    p, pairs, normaliser = crf.Chains(bounds).marginals(good, initial, moves)
    expected, totals = np.zeros((2, 2)), []
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            own, both, total = brute_marginals(good[a:b], initial, moves)
            np.testing.assert_allclose(p[a:b], own)
            expected += both
            totals.append(total)
    np.testing.assert_allclose(pairs, expected)
    np.testing.assert_allclose(sorted(normaliser), sorted(totals))


def plain_features(text):
    """The features of a text's lines that come from words, one line at a time."""
    rows, seen_pairs, seen_lines, before = [], set(), set(), None
    for line in (text or "").split("\n"):
        words = line.encode().split()
        if not words:
            continue
        again = sum(a == b for a, b in zip(words, words[1:]))
        pairs = 0
        for word in words:
            if before is not None:
                pairs += (before, word) in seen_pairs
                seen_pairs.add((before, word))
            before = word
        rows.append(
            [
                len(line.encode()),
                len(words),
                len(set(words)),
                again / len(words),
                pairs / len(words),
                float(line in seen_lines),
            ]
        )
        seen_lines.add(line)
    return rows


TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    GOOD,
    BAD,
    "a b a b\n\n  a b\na b a b\nç é ü 12 | 3 |\x00 ok...\r\n漢字 漢字!",
    "\n".join(f"line {i % 7} of many words" for i in range(500)),
    "word " * 60_000,
]


def test_features_of_lines():
    lines = crf.line_features(pa.array(TEXTS, pa.string()))
    names = {name: i for i, name in enumerate(crf.FEATURES)}
    for number, text in enumerate(TEXTS):
        own = slice(lines.bounds[number], lines.bounds[number + 1])
        got, expected = lines.features[own], np.array(plain_features(text)).reshape(-1, 6)
        assert len(got) == len(expected)
        np.testing.assert_array_equal(lines.sizes[own], expected[:, 0])
        np.testing.assert_allclose(got[:, names["words"]], np.log1p(expected[:, 1]), rtol=1e-5)
        np.testing.assert_allclose(
            got[:, names["distinct words"]], np.log1p(expected[:, 2]) / np.log1p(expected[:, 1]), rtol=1e-5
        )
        for name, column in (("word before again", 3), ("pair of words seen above", 4), ("line seen above", 5)):
            np.testing.assert_allclose(got[:, names[name]], expected[:, column], atol=1e-6)
        shares = got[:, : len(crf.CLASSES)] ** 2
        np.testing.assert_allclose(shares.sum(axis=1), 1, rtol=1e-4)


def test_no_text_sees_another():
    alone = [crf.line_features(pa.array([t], pa.string())).features for t in TEXTS]
    together = crf.line_features(pa.array(TEXTS, pa.string())).features
    np.testing.assert_array_equal(np.concatenate(alone), together)


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    return labels, QUERIES["op11_quality_classifier"](spark, FOLDER).collect()


def test_held_out_documents(spark, scored):
    labels, rows = scored
    assert sorted(r.doc_id for r in rows) == sorted(
        r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()
    )
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert {0, 1} == {label for label, _ in held}
    assert sum(label == predicted for label, predicted in held) >= 0.98 * len(held)


def corpus(spark, extra=False):
    docs = [(i, GOOD + f"\nIt is said that {i} people have seen it.") for i in range(30)]
    docs += [(100 + i, f"Offer {i}.\n" + BAD) for i in range(30)]
    frame = spark.createDataFrame(docs, SCHEMA)
    if extra:
        for name in ("label", "score", "n", "features", "line_quality", "lang"):
            frame = frame.withColumn(name, F.lit("other"))
    labels = [(i, int(i < 100)) for i, _ in docs]
    return frame, labels


def test_null_and_odd_texts(spark):
    docs, labels = corpus(spark, extra=True)
    odd = [(5, 1), (5, 0), (None, 1), (0, None), (0, 1), (7777, 0)]
    model = crf.train(docs, spark.createDataFrame(labels + odd, "doc_id long, label int"))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, GOOD), (4, GOOD), (4, GOOD)]
    found = crf.score(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")), model).collect()
    assert len(found) == len(rows)
    by_text = {i: r for r, (i, _) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])))}
    assert by_text[4].score > 0.9 and by_text[5].score < 0.1
    for empty in (0, 1, 2):
        assert by_text[empty].score == pytest.approx(model.prior) and by_text[empty].line_quality == []
    assert len({r.score for r in found if r.doc_id == 4}) == 1 and len(by_text[7].line_quality) == 500


def test_mixed_texts_lie_between(spark):
    docs, labels = corpus(spark)
    model = crf.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    mixed = GOOD + "\n" + GOOD + "\n" + BAD
    scores = {
        r.doc_id: r for r in crf.score(spark.createDataFrame([(1, GOOD), (2, mixed), (3, BAD)], SCHEMA), model).collect()
    }
    assert scores[1].score > scores[2].score > scores[3].score
    assert min(scores[2].line_quality[:3]) > max(scores[2].line_quality[-2:])


def test_order_of_rows_and_partitions_change_nothing(spark):
    docs, labels = corpus(spark)
    labels = spark.createDataFrame(labels, "doc_id long, label int")
    one = crf.train(docs.coalesce(1), labels)
    other = crf.train(docs.orderBy(F.rand(3)).repartition(7), labels.repartition(5))
    np.testing.assert_array_equal(one.weights, other.weights)
    assert (one.slope, one.shift, one.prior) == (other.slope, other.shift, other.prior)


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    model = crf.train(docs, none)
    assert {r.score for r in crf.score(docs, model).collect()} == {0.5}
    one_kind = crf.train(docs, spark.createDataFrame([x for x in labels if x[1]], "doc_id long, label int"))
    assert {round(r.score, 9) for r in crf.score(docs, one_kind).collect()} == {round(31 / 32, 9)}
    assert crf.score(spark.createDataFrame([], SCHEMA), model).collect() == []
    empty = crf.train(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, label int"))
    assert empty.prior == 0.5
