import math
from collections import Counter, defaultdict

import pytest

from assayframe.llm import language_id
from assayframe.llm.language_id import LONGEST_GRAM, SMOOTHING, grams_of, letter_words

ROWS = [
    (1, "en", "the cat and the dog"),
    (2, "en", "the house of the cat"),
    (3, "de", "der hund und die katze"),
    (4, "de", "das haus und der hund"),
    (5, None, "kein lernen"),
    (6, "en", None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


class ByHand:
    """The whole method over plain dictionaries, with every count."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), defaultdict(Counter)
        for _, lang, text in rows:
            if lang is not None and text is not None:
                self.words[lang].update(letter_words(text))
        self.words = {lang: counts for lang, counts in self.words.items() if counts}
        for lang, counts in self.words.items():
            for word, n in counts.items():
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        self.grams[lang, size][gram] += n
        self.languages = sorted(self.words)

    def log(self, counts, entry):
        return math.log((counts[entry] + SMOOTHING) / (counts.total() + SMOOTHING * 10_000))

    def word(self, word):
        if any(word in counts for counts in self.words.values()):
            return [self.log(self.words[g], word) for g in self.languages]
        for size in range(LONGEST_GRAM, 0, -1):
            known = [
                gram
                for gram in grams_of(word, size)
                if any(gram in self.grams[g, size] for g in self.languages)
            ]
            if known:
                return [
                    sum(self.log(self.grams[g, size], gram) for gram in known) / len(known)
                    for g in self.languages
                ]
        return [0.0] * len(self.languages)

    def __call__(self, text):
        words = letter_words(text)
        if not words or not self.languages:
            return "und", 0.0
        sums = [math.fsum(column) for column in zip(*map(self.word, words))]
        top = max(sums)
        best = next(i for i, s in enumerate(sums) if s >= top - 1e-9 * max(1, abs(top)))
        return self.languages[best], 1 / math.fsum(math.exp(s - sums[best]) for s in sums)


def predicted(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(texts)
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}


def held_against(spark, model, exact, texts):
    for i, (lang, score) in predicted(spark, model, texts).items():
        expected = exact(texts[i])
        assert lang == expected[0], texts[i][:80]
        assert math.isclose(score, expected[1], rel_tol=1e-6)


TEXTS = [
    "The THE", "der", "hunde", "the hunde", "katzen und dogs", "haaaas", "aaaa", "t", "x",
    "漢字", "漢字 the", "the the der der", "hund" * 300, "zzz", "of of of haus",
]


@pytest.mark.parametrize("broadcast", [0, 3, 200_000])
def test_all_words_by_hand(spark, monkeypatch, broadcast):
    """The same whichever words are broadcast, and none need be."""
    monkeypatch.setattr(language_id, "BROADCAST_WORDS", broadcast)
    model = language_id.train(frame(spark))
    assert model.languages == ["de", "en"]
    assert len(model.common) <= broadcast
    held_against(spark, model, ByHand(ROWS), TEXTS)


@pytest.mark.parametrize("broadcast", [50, 200_000])
def test_whole_table_by_hand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(language_id, "BROADCAST_WORDS", broadcast)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.where("doc_id % 4 <> 2").select("doc_id", "lang", "text").collect()]
    texts = [r["text"] for r in docs.where("doc_id % 4 = 2").select("text").collect()]
    model = language_id.train(frame(spark, rows))
    held_against(spark, model, ByHand(rows), texts)


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    """The commonest words are all those of another language."""
    import random

    monkeypatch.setattr(language_id, "BROADCAST_WORDS", 200)
    draw = random.Random(5)
    letters = "abcdefghiklmnoprstu"
    invent = lambda n: ["".join(draw.choices(letters, k=7)) for _ in range(n)]
    frequent, rare = invent(3000), invent(600)
    text = lambda words: " ".join(draw.choices(words, k=40))
    rows = [(i, "aa", text(frequent)) for i in range(2000)]
    rows += [(i, "zz", text(rare)) for i in range(2000, 2060)]
    model = language_id.train(frame(spark, rows))
    texts = [text(rare) for _ in range(60)] + [text(frequent) for _ in range(60)]
    found = predicted(spark, model, texts)
    assert [found[i][0] for i in range(120)] == ["zz"] * 60 + ["aa"] * 60


def test_nothing_to_go_by(spark):
    model = language_id.train(frame(spark))
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, "½ ²"), (5, "漢字")]
    docs = spark.createDataFrame([(i, t, 9.0, "x") for i, t in texts], "doc_id long, text string, score double, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4
    # Letters without evidence: a tie, which the first language takes.
    assert got[5] == ("de", 0.5)


def test_nothing_to_learn_from_and_no_rows(spark):
    for rows in ([], [(1, "en", "12 !"), (2, None, "text")]):
        model = language_id.train(frame(spark, rows))
        assert model.languages == []
        docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
        assert language_id.predict(docs, model).first()["lang_pred"] == "und"
        assert language_id.predict(docs.limit(0), model).count() == 0
    model = language_id.train(frame(spark))
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = ROWS + ROWS[:1] * 3
    model = language_id.train(frame(spark, rows))
    docs = spark.createDataFrame(
        [(1, "the", "k", 7, 1), (1, "the", "k", 7, 1), (None, "der", "k", 7, 1), (None, None, None, None, None)],
        "doc_id long, text string, key_a string, key_b long, n long",
    )
    found = language_id.predict(docs, model)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    assert sorted(r["lang_pred"] for r in found.collect()) == ["de", "en", "en", "und"]
    exact = ByHand(rows)
    scores = [r["score"] for r in found.where("text = 'the' AND key_a = 'k' AND key_b = 7").collect()]
    assert len(scores) == 2
    assert all(math.isclose(s, exact("the")[1], rel_tol=1e-9) for s in scores)


def test_a_very_long_text(spark):
    model = language_id.train(frame(spark))
    long_one = "der hund und " * 100_000 + " ".join(f"wort{'abcdefgh'[i % 8]}{chr(97 + i % 26) * (i % 50)}" for i in range(5000))
    held_against(spark, model, ByHand(ROWS), [long_one, "the"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs.where("doc_id % 4 <> 2"))
    found = language_id.predict(docs.where("doc_id % 4 = 2"), model)
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
