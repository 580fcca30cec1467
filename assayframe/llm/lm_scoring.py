"""A log-bilinear language model and a unigram base, over whole texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import content_key, folded_words, in_batches
from assayframe.sources.scratch import materialize

ADDED = 0.1
# The end of a text; no word is empty.
END = b""
# Output units of the model: the end, the commonest words, and buckets that share the
# other words by their first bytes.
COMMON_WORDS, BUCKETS = 767, 256
UNITS = 1 + COMMON_WORDS + BUCKETS
# Words whose counts each task has at hand. The counts of all others are joined.
DICTIONARY = 200_000
DIMENSIONS = 16
MINIBATCH, NOISE, RATE, SEED = 8192, 25, 0.1, 11
LN10 = math.log(10.0)


def bucket_of(word: bytes) -> int:
    return 1 + COMMON_WORDS + zlib.crc32(word[:3]) % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "c"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(folded_words(text))
            counts[END] += 1
        if len(counts) > 300_000:
            yield flush(counts)
            counts = Counter()
    if counts:
        yield flush(counts)


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of all tokens of all rows; the end has the empty word."""
    counted = in_batches(docs.select("text"), _count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need of the counts. ``rows`` numbers the words at hand; the arrays
    go by that number: unit, count, and log share of the word in its unit."""

    total: int
    distinct: int
    rows: dict[bytes, int]
    unit: np.ndarray
    count: np.ndarray
    inner: np.ndarray
    unit_share: np.ndarray
    bucket_log_mass: np.ndarray

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Row in the dictionary (or -1) and unit of each word, and the other words."""
        rows = np.fromiter((self.rows.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        absent = np.flatnonzero(rows < 0)
        others = [words[i] for i in absent]
        units = self.unit[rows]
        units[absent] = [bucket_of(w) for w in others]
        return rows, units, others


def _least_count(counts: DataFrame, most: int) -> int:
    """Least count that at most ``most`` words reach. Counts are gathered as they are
    up to 1,000 and by thousandths of their logarithm beyond."""
    level = F.when(F.col("c") <= 1000, F.col("c")).otherwise(
        F.ceil(F.pow(F.lit(1.001), F.ceil(F.log(F.col("c").cast("double")) / math.log(1.001))))
    )
    sizes = counts.groupBy(level.cast("long").alias("level")).count().collect()
    kept, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["level"]):
        kept += row["count"]
        if kept > most:
            break
        least = row["level"]
    if least is None:
        return (1 << 62) if sizes else 1
    return least if least <= 1000 else int(least / 1.002)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Read the counted words. The driver gets at most about ``DICTIONARY`` of them,
    and a row per bucket."""
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    at_hand = counts.where((F.col("c") >= _least_count(counts, DICTIONARY)) & (F.length("word") > 0))
    found = at_hand.toArrow()
    words, c = found.column("word").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], c[order] if len(order) else np.zeros(0, np.int64)
    unit = np.array(
        [1 + i if i < COMMON_WORDS else bucket_of(w) for i, w in enumerate(words)] + [0], dtype=np.int64
    )
    # Mass and tokens of each bucket, over every word that is not common.
    common = words[:COMMON_WORDS]
    bucket = 1 + COMMON_WORDS + F.crc32(F.substring("word", 1, 3)) % BUCKETS
    rest = counts.where((F.length("word") > 0) & ~F.col("word").isin([bytearray(w) for w in common])) if common else counts.where(F.length("word") > 0)
    mass, tokens = np.zeros(UNITS), np.zeros(UNITS)
    for r in rest.groupBy(bucket.cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["b"]], tokens[r["b"]] = r["c"] + ADDED * r["v"], r["c"]
    # One word more in each bucket: any that was never seen.
    mass += ADDED
    ends = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    tokens[0] = ends
    tokens[1 : 1 + len(common)] = c[: len(common)]
    inner = np.append(np.where(unit[:-1] > COMMON_WORDS, np.log(c + ADDED) - np.log(mass[unit[:-1]]), 0.0), 0.0)
    share = (tokens + 1.0) / (tokens + 1.0).sum()
    return Vocabulary(
        total,
        distinct,
        {w: i for i, w in enumerate(words)},
        unit,
        np.append(c, 0),
        inner,
        share,
        np.log(mass),
    )


@dataclass
class Model:
    """Score of unit w after u2, u1: (R[u1] C1 + R[u2] C2) . Q[w] + b[w]."""

    R: np.ndarray
    C1: np.ndarray
    C2: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.R, self.C1, self.C2, self.Q, self.b]


def untrained(share: np.ndarray) -> Model:
    random = np.random.default_rng(SEED)
    small = lambda *shape: random.standard_normal(shape) * 0.1
    return Model(
        small(UNITS, DIMENSIONS),
        np.eye(DIMENSIONS) * 0.7,
        np.eye(DIMENSIONS) * 0.5,
        small(UNITS, DIMENSIONS),
        np.log(share),
    )


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the value rows that fall to each of n rows."""
    width = values.shape[1]
    at = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, weights=values.ravel(), minlength=n * width).reshape(n, width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Trainer:
    """Noise-contrastive estimation by minibatches with shared noise and adaptive rates."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.model, self.share = model, share
        self.squares = [np.full(a.shape, 1e-2) for a in model.arrays()]
        self.random = np.random.default_rng(seed)
        self.edges = np.cumsum(share)

    def step(self, u2: np.ndarray, u1: np.ndarray, w: np.ndarray) -> None:
        m, n = self.model, len(w)
        noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), UNITS - 1)
        log_noise = np.log(NOISE * self.share)
        r1, r2 = m.R[u1], m.R[u2]
        context = r1 @ m.C1 + r2 @ m.C2
        q, qn = m.Q[w], m.Q[noise]
        true = np.einsum("ij,ij->i", context, q) + m.b[w] - log_noise[w]
        false = context @ qn.T + m.b[noise] - log_noise[noise]
        up, down = (1 - _sigmoid(true)) / n, -_sigmoid(false) / n
        g_context = up[:, None] * q + down @ qn
        g_q = _summed(w, up[:, None] * context, UNITS)
        np.add.at(g_q, noise, down.T @ context)
        g_b = np.bincount(w, weights=up, minlength=UNITS)
        np.add.at(g_b, noise, down.sum(axis=0))
        g_r = _summed(u1, g_context @ m.C1.T, UNITS) + _summed(u2, g_context @ m.C2.T, UNITS)
        for value, square, g in zip(
            m.arrays(), self.squares, (g_r, r1.T @ g_context, r2.T @ g_context, g_q, g_b)
        ):
            g = g * n / 32
            square += g * g
            value += RATE * g / np.sqrt(square)


def _train(vocab, start):
    """Train from the same start on the texts of a partition; a row per matrix row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocab.value
        trainer, seen, seed = None, 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if trainer is None:
                seed = zlib.crc32((texts[0] or "").encode("utf-8")) + SEED
                model = Model(*(a.copy() for a in start.value.arrays()))
                trainer = Trainer(model, words.unit_share, seed)
            contexts: list[np.ndarray] = []
            for text in texts:
                units = words.units_of(folded_words(text))[1]
                contexts.append(np.concatenate([[0, 0], units, [0]]))
            for u2, u1, w in _minibatches(contexts, trainer.random):
                trainer.step(u2, u1, w)
                seen += len(w)
        if trainer is None:
            return
        m = trainer.model
        wide = np.vstack(
            [m.R, m.C1, m.C2, m.Q, np.pad(m.b, (0, -UNITS % DIMENSIONS)).reshape(-1, DIMENSIONS)]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(wide)), pa.int32()),
                pa.array(np.full(len(wide), float(seen))),
                *(pa.array(wide[:, j]) for j in range(DIMENSIONS)),
            ],
            names=["row", "weight", *(f"v{j}" for j in range(DIMENSIONS))],
        )

    return run


def _minibatches(sequences: list[np.ndarray], random):
    """Contexts and targets of all places in the sequences, shuffled."""
    u2 = np.concatenate([s[:-2] for s in sequences])
    u1 = np.concatenate([s[1:-1] for s in sequences])
    w = np.concatenate([s[2:] for s in sequences])
    order = random.permutation(len(w))
    for start in range(0, len(w), MINIBATCH):
        part = order[start : start + MINIBATCH]
        yield u2[part], u1[part], w[part]


def train(docs: DataFrame, vocab, share: np.ndarray) -> Model:
    """One pass over all rows of ``text``: partitions train side by side from the same
    start, and Spark averages their parameters by the tokens they saw."""
    start = untrained(share)
    columns = [f"v{j}" for j in range(DIMENSIONS)]
    schema = "row int, weight double, " + ", ".join(f"{c} double" for c in columns)
    sent = docs.sparkSession.sparkContext.broadcast(start)
    trained = in_batches(docs.select("text"), _train(vocab, sent), schema)
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
    rows = trained.where("weight > 0").groupBy("row").agg(*map(mean, columns)).orderBy("row").collect()
    if not rows:
        return start
    wide = np.array([[r[c] for c in columns] for r in rows])
    r, c1, c2, q, b = np.split(
        wide, np.cumsum([UNITS, DIMENSIONS, DIMENSIONS, UNITS])
    )
    return Model(r, c1, c2, q, b.ravel()[:UNITS])


def normalised(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables whose sum ``first[u1, w] + second[u2, w] - norm[u1, u2]`` is the log
    probability of unit w.

    Each context has two units, so the batch of all contexts is their square, and
    the normaliser of all of them is a product of two matrices.
    """
    first = model.R @ model.C1 @ model.Q.T + model.b
    second = model.R @ model.C2 @ model.Q.T
    top1, top2 = first.max(axis=1), second.max(axis=1)
    product = np.exp(first - top1[:, None]) @ np.exp(second - top2[:, None]).T
    return first, second, np.log(product) + top1[:, None] + top2[None, :]


def _score(vocab, tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (first, second, norm) = vocab.value, tables.value
        log_count = np.log10(words.count + ADDED)
        for batch in batches:
            known, scores, bases, lengths, tails, tail_counts = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                rows, units, others = words.units_of(folded_words(text))
                u = np.concatenate([[0, 0], units, [0]])
                u2, u1, w = u[:-2], u[1:-1], u[2:]
                logs = first[u1, w].sum() + second[u2, w].sum() - norm[u1, u2].sum()
                here = rows[rows >= 0]
                logs += words.inner[here].sum()
                rare = Counter(others)
                absent = units[rows < 0]
                logs -= words.bucket_log_mass[absent].sum()
                scores.append(float(logs) / LN10)
                bases.append(float(log_count[here].sum()))
                known.append(len(here))
                lengths.append(len(rows) + 1)
                tails.append(list(rare))
                tail_counts.append(list(rare.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "key_a", "key_b")),
                    pa.array(lengths, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(bases, pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array(tails, pa.list_(pa.binary())),
                    pa.array(tail_counts, pa.list_(pa.int32())),
                ],
                names=SCORED,
            )

    return run


SCORED = ["doc_id", "key_a", "key_b", "n_tokens", "known", "base", "model", "words", "times"]


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of
    ``docs``, learning from the rows of ``learn`` (both with ``text``).

    Tokens are the words between ASCII white space, A to Z lower-cased, and one end.
    ``base_score`` is the log10 probability under smoothed token counts, ``score``
    under the model: of a token's unit given the two units before, and of the token
    in its unit by smoothed counts. Both sum to one over all words seen and one that
    stands for the others. Null and empty texts are an end alone. Without rows to
    learn from all units are about as likely. Repeated rows stay.

    Tasks hold the counts of the commonest words. The others of each text are joined
    with the counts of all words; equal texts bring theirs once.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(learn), "lm-counts")
    words = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(words)
    tables = spark.sparkContext.broadcast(
        tuple(t.astype(np.float32) for t in normalised(train(learn, vocab, words.unit_share)))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", *content_key(F.col("text")))
    schema = (
        f"doc_id {kind}, key_a long, key_b long, n_tokens long, known long, base double, model double, "
        "words array<binary>, times array<int>"
    )
    scored = materialize(in_batches(keyed, _score(vocab, tables), schema), "lm-scored")
    rare = (
        scored.select("key_a", "key_b", F.explode(F.arrays_zip("words", "times")).alias("t"))
        .select("key_a", "key_b", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
        .repartition("word")
        .groupBy("word", "key_a", "key_b")
        .agg(F.max("times").alias("times"))
    )
    weight = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADDED))
    tails = materialize(
        rare.join(counts.where(F.length("word") > 0), "word", "left")
        .groupBy("key_a", "key_b")
        .agg(
            F.sum(F.col("times") * weight).alias("tail"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        ),
        "lm-tails",
    )
    ends = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    tail = F.coalesce("tail", F.lit(0.0))
    divisor = math.log10(words.total + ADDED * (words.distinct + 1))
    return scored.drop("words", "times").join(tails, ["key_a", "key_b"], "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail + F.lit(math.log10(ends + ADDED)) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model") + tail).alias("score"),
    )
