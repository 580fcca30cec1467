"""Language identification by words, backing off to character n-grams.

Words that are common in the training texts are scored where a text is read, from a
broadcast table of bounded size. The evidence of all other words is joined to them, with
the counts of every word and n-gram there is, so that the bound moves work but no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import content_key, in_batches
from assayframe.sources.scratch import materialize

UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")
LONGEST_GRAM = 5
# Words scored where a text is read: so many, and so many log frequencies of them, some
# 13 MB. They bound what is broadcast; rarer words are joined.
BROADCAST_WORDS = 200_000
BROADCAST_CELLS = 1_600_000
# A word counts for at least this much where a language never had it.
SMOOTHING = 0.5
# Sums this close, in parts of the larger, are a tie: the order of adding is left open.
TIE = 1e-9
PAIR = ["key_a", "key_b"]


@dataclass(frozen=True)
class LanguageModel:
    """Counts per language as log frequencies.

    ``bases[k, l]`` is the log frequency in language ``l`` of what it never had: a word
    (``k`` = 0) or an n-gram of ``k`` letters. ``words`` holds ``(key_a, key_b,
    evidence)`` for each word of the training texts and ``grams`` ``(size, entry,
    language, gain)`` for each n-gram. A gain is what a count adds to the base; evidence
    is a list of ``(at, value)``, gains at the number of a language and a 1 at the number
    of languages plus ``k``, which asks for the base.
    """

    languages: list[str]
    bases: np.ndarray
    common: dict[str, int]
    common_logs: np.ndarray
    words: DataFrame | None
    grams: DataFrame | None


def letter_words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, size: int) -> list[str]:
    """n-grams of a word between its blank borders; single letters without them."""
    if size == 1:
        return list(word)
    bordered = f" {word} "
    return [bordered[i : i + size] for i in range(len(bordered) - size + 1)]


def _flushed(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang for lang, _ in keys], pa.string()),
            pa.array([entry for _, entry in keys], pa.string()),
            pa.array([counts[key] for key in keys], pa.int64()),
        ],
        names=["lang", "entry", "n"],
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        flat = Counter({(g, w): n for g, own in counts.items() for w, n in own.items()})
        if flat:
            yield _flushed(flat)

    for batch in batches:
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text"))):
            counts.setdefault(lang, Counter()).update(letter_words(text))
        held = sum(map(len, counts.values()))
        if held > 200_000:
            yield from flush()
            counts = {}
    yield from flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "entry", "n"))
        for lang, word, n in zip(*columns):
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams_of(word, size):
                    counts[lang, gram] += n
        if len(counts) > 200_000:
            yield _flushed(counts)
            counts = Counter()
    if counts:
        yield _flushed(counts)


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """Entries above the least count that leaves at most ``most`` of them.

    Only a histogram of the counts, one row per power of 1.1, reaches the driver.
    """
    step = math.log(1.1)
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    sizes = counts.groupBy(level.alias("level")).count().collect()
    kept, least = 0, math.inf
    for row in sorted(sizes, key=lambda r: -r["level"]):
        kept += row["count"]
        if kept > most:
            break
        least = row["level"]
    return counts.where(level >= F.lit(float(least)))


def _gain(n: Column) -> Column:
    return F.log((n + F.lit(SMOOTHING)) / F.lit(SMOOTHING))


def _at(number: Column | int, value: Column) -> Column:
    place = F.lit(number) if isinstance(number, int) else number
    return F.struct(place.cast("int").alias("at"), value.cast("double").alias("value"))


def train(labelled: DataFrame) -> LanguageModel:
    """Fit on every row of ``lang`` and ``text`` where both are given.

    Words are counted per language in Spark; n-gram counts follow from the word
    counts. Repeated rows count as often as they occur. Rows without a language or text
    teach nothing; with no words at all the model has no language and answers ``und``.
    Totals of each language and the commonest words reach the driver, counts don't.
    """
    known = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = "lang string, entry string, n long"
    words = materialize(
        in_batches(known, _count_words, counted).groupBy("lang", "entry").agg(F.sum("n").alias("n")),
        "language-words",
    )
    grams = materialize(
        in_batches(words, _count_grams, counted)
        .groupBy("lang", F.length("entry").alias("size"), "entry")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    word_totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(word_totals)
    if not languages:
        nothing = np.zeros((LONGEST_GRAM + 1, 0))
        return LanguageModel([], nothing, {}, nothing, None, None)
    # Each length is a distribution of its own.
    totals = np.zeros((LONGEST_GRAM + 1, len(languages)))
    totals[0] = [word_totals[g] for g in languages]
    for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        totals[r["size"], languages.index(r["lang"])] = r["n"]
    bases = np.log(SMOOTHING / (totals + SMOOTHING * 10_000))
    named = [F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]
    language = F.create_map(*named)[F.col("lang")]
    entries = materialize(
        words.groupBy("entry")
        .agg(
            F.collect_list(_at(language, _gain(F.col("n")))).alias("evidence"),
            F.sum("n").alias("n"),
        )
        .withColumn("evidence", F.concat("evidence", F.array(_at(len(languages), F.lit(1.0)))))
        .select("entry", *content_key(F.col("entry")), "evidence", "n"),
        "language-evidence",
    )
    most = min(BROADCAST_WORDS, BROADCAST_CELLS // len(languages))
    found = _commonest(entries, most).select("entry", "evidence").toArrow()
    common = {word: i for i, word in enumerate(found.column("entry").to_pylist())}
    logs = np.tile(bases[0], (len(common), 1))
    lists = found.column("evidence").combine_chunks()
    row = np.repeat(np.arange(len(common)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at, value = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    of_language = at < len(languages)
    logs[row[of_language], at[of_language]] += value[of_language]
    return LanguageModel(
        languages,
        bases,
        common,
        logs,
        entries.select(*PAIR, "evidence"),
        grams.select("size", "entry", language.alias("language"), _gain(F.col("n")).alias("gain")),
    )


def _read_texts(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``(key_a, key_b, text, n_words, sums, rarer)`` of each different text: a number that
    stands for it, log frequencies of its common words, and the other words with their
    counts. The numbers are written, so that they stay the same for all who read them."""
    sent = texts.sparkSession.sparkContext.broadcast((model.common, model.common_logs))
    width = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logs = sent.value
        for batch in batches:
            n_words, sums = [], np.zeros((batch.num_rows, width))
            words, counts, ends = [], [], [0]
            for i, text in enumerate(batch.column("text").to_pylist()):
                counted = Counter(letter_words(text))
                n_words.append(counted.total())
                rows, times = [], []
                for word, n in counted.items():
                    row = common.get(word)
                    if row is None:
                        words.append(word)
                        counts.append(n)
                    else:
                        rows.append(row)
                        times.append(n)
                if rows:
                    sums[i] = np.array(times, dtype=float) @ logs[rows]
                ends.append(len(words))
            pairs = pa.StructArray.from_arrays(
                [pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"]
            )
            steps = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * np.int32(width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key_a"),
                    batch.column("key_b"),
                    pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(steps, pa.array(sums.ravel())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ],
                names=["key_a", "key_b", "n_words", "sums", "rarer"],
            )

    schema = (
        "key_a long, key_b long, n_words long, sums array<double>, "
        "rarer array<struct<word: string, n: long>>"
    )
    read = in_batches(texts.select(*content_key(F.col("text")), "text"), run, schema)
    once = [F.first(name).alias(name) for name in ("n_words", "sums", "rarer")]
    different = read.groupBy(*PAIR).agg(*once)
    return materialize(
        different.select(
            *PAIR, F.monotonically_increasing_id().alias("text"), "n_words", "sums", "rarer"
        ),
        "language-texts",
    )


def _grams_of_words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, entries, times = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                counted = Counter(grams_of(word, size))
                place += [i] * len(counted)
                entries += counted.keys()
                times += counted.values()
            place = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("number").take(place),
                    pa.array(entries, pa.string()),
                    pa.array(times, pa.int64()),
                ],
                names=["number", "entry", "times"],
            )

    return run


def unseen_evidence(unseen: DataFrame, model: LanguageModel) -> DataFrame:
    """``(number, evidence)`` of words that the training texts don't have, a stored row of
    ``(number, word)`` each: the mean log frequencies of a word's longest n-grams of
    which any is known. Words without a known letter are left out.

    Only the words for which a length has nothing go on to the next shorter one.
    """
    width = len(model.languages)
    left, found = unseen, []
    for size in range(LONGEST_GRAM, 0, -1):
        pieces = in_batches(left, _grams_of_words(size), "number long, entry string, times long")
        known = (
            model.grams.where(F.col("size") == size)
            .groupBy("entry")
            .agg(F.collect_list(_at(F.col("language"), F.col("gain"))).alias("gains"))
        )
        one = F.array(_at(width + size, F.lit(1.0)))
        summed = (
            pieces.join(known, "entry")
            .select("number", "times", F.inline(F.concat("gains", one)))
            .groupBy("number", "at")
            .agg(F.sum(F.col("times") * F.col("value")).alias("value"))
        )
        # The n-grams found are counted at the last place of all.
        lists = summed.groupBy("number").agg(
            F.collect_list(_at(F.col("at"), F.col("value"))).alias("sums"),
            F.max_by("value", "at").alias("n"),
        )
        mean = F.transform("sums", lambda s: _at(s["at"], s["value"] / F.col("n")))
        found.append(materialize(lists.select("number", mean.alias("evidence")), f"language-unseen-{size}"))
        if size > 1:
            left = materialize(left.join(found[-1], "number", "left_anti"), f"language-left-{size}")
            if left.isEmpty():
                break
    evidence = found[0]
    for more in found[1:]:
        evidence = evidence.unionByName(more)
    return evidence


def _joined_sums(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``(text, joined)``: summed evidence of the words that were not broadcast."""
    rarer = texts.select("text", F.inline("rarer"))
    keyed = rarer.select("text", *content_key(F.col("word")), "word", "n")
    without = keyed.select(*PAIR, "word").dropDuplicates(PAIR).join(model.words, PAIR, "left_anti")
    unseen = materialize(
        without.withColumn("number", F.monotonically_increasing_id()), "language-unseen"
    )
    found = unseen_evidence(unseen.select("number", "word"), model)
    evidence = model.words.unionByName(
        unseen.drop("word").join(found, "number").select(*PAIR, "evidence")
    )
    return (
        keyed.drop("word")
        .join(evidence, PAIR)
        .select("text", "n", F.inline("evidence"))
        .groupBy("text", "at")
        .agg(F.sum(F.col("n") * F.col("value")).alias("value"))
        .groupBy("text")
        .agg(F.collect_list(_at(F.col("at"), F.col("value"))).alias("joined"))
    )


def _decided(model: LanguageModel):
    languages, bases = model.languages, model.bases
    width = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = batch.column("joined")
            lengths = joined.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at, value = (
                joined.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1)
            )
            gathered = np.zeros((batch.num_rows, width + LONGEST_GRAM + 1))
            np.add.at(gathered, (row, at), value)
            sums = np.vstack([np.zeros((0, width)), *batch.column("sums").to_pylist()])
            sums = sums + gathered[:, :width] + gathered[:, width:] @ bases
            top = sums.max(axis=1, keepdims=True)
            tied = sums >= top - TIE * np.maximum(1.0, np.abs(top))
            best = tied.argmax(axis=1)
            share = 1 / np.exp(sums - sums[np.arange(len(best)), best][:, None]).sum(axis=1)
            empty = np.array(batch.column("n_words").to_pylist(), dtype=np.int64) == 0
            labels = [UNDETERMINED if e else languages[b] for e, b in zip(empty, best)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key_a"),
                    batch.column("key_b"),
                    pa.array(labels, pa.string()),
                    pa.array(np.where(empty, 0.0, np.minimum(share, 1.0))),
                ],
                names=["key_a", "key_b", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row, from ``text`` alone.

    ``score`` is the share of the best language in the likelihood of the words,
    0 to 1; ties go to the first language by name. Null texts and texts without a
    letter get ``und`` and 0. Repeated rows stay, equal texts are read as one. Columns
    of these names are replaced; all others are kept, whatever their names.
    """
    kept = docs.drop("lang_pred", "score")
    if not model.languages:
        return kept.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    texts = _read_texts(kept, model)
    rows = texts.drop("rarer").join(_joined_sums(texts, model), "text", "left")
    decided = in_batches(
        rows, _decided(model), "key_a long, key_b long, lang_pred string, score double"
    )
    own = []
    for name in PAIR:
        while name in kept.columns or name in own:
            name += "_"
        own.append(name)
    keys = dict(zip(own, content_key(F.col("text"))))
    named = decided.withColumnsRenamed(dict(zip(PAIR, own)))
    return (
        kept.withColumns(keys)
        .join(named, own)
        .select(*kept.columns, "lang_pred", "score")
    )
