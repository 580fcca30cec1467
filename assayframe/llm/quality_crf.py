"""Document quality from a conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import in_batches
from assayframe.llm.periodic_runs import BATCH_BYTES, sliced
from assayframe.sources.scratch import materialize

# The field is fitted on a sample: for each label, the documents first in the order of a
# hash of their ids, at most so many and with at most so many lines each.
FIT_DOCUMENTS, FIT_LINES = 1_500, 200
# Steps and step size of the ascent, and the weight of the squared parameters.
STEPS, RATE, PENALTY = 200, 0.1, 1e-3
# Rounds of fitting; after the first, lines of low-quality documents that look good count as good.
ROUNDS = 2

# Classes of bytes whose shares describe a line: each ASCII mark for itself.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = ["lower", "upper", "digit", "blank", "beyond ASCII", "control", *MARKS]
FEATURES = [
    *CLASSES,
    "length",
    "words",
    "word length",
    "distinct words",
    "word before again",
    "pair of words seen above",
    "line seen above",
    "words without letters",
    "ends a sentence",
]


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, CLASSES.index("control"), dtype=np.int64)
    kinds[0x80:] = CLASSES.index("beyond ASCII")
    kinds[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    kinds[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    kinds[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    kinds[[0x20, *range(0x09, 0x0E)]] = CLASSES.index("blank")
    for number, mark in enumerate(MARKS):
        kinds[ord(mark)] = len(CLASSES) - len(MARKS) + number
    return kinds


KINDS = _byte_classes()


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of strings (large ones), and where each begins."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _seen_above(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a key has occurred before for the same owner (owners ascend)."""
    width = int(keys.max(initial=0)) + 1
    if width > (1 << 62) // (int(owner.max(initial=0)) + 1):
        keys = np.unique(keys, return_inverse=True)[1]
        width = len(keys)
    both = owner * width + keys
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = both[order[1:]] == both[order[:-1]]
    seen = np.zeros(len(keys), dtype=bool)
    # The sort is stable, so the first of equal keys is the earliest.
    seen[order] = same
    return seen


@dataclass
class Lines:
    """Lines with words of some texts: the lines of a text are ``bounds[i]`` up to
    ``bounds[i + 1]``; ``sizes`` has their bytes."""

    bounds: np.ndarray
    sizes: np.ndarray
    features: np.ndarray


def line_features(texts: pa.Array) -> Lines:
    """Describe the lines of texts, by their own bytes and words and by what the text
    had above. Lines without a word are left out."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    all_lines, line_owner = split.flatten(), np.repeat(
        np.arange(len(texts)), pc.list_value_length(split).to_numpy()
    )
    filled = pc.match_substring_regex(all_lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    owner = line_owner[filled]
    lines = all_lines.filter(pa.array(filled))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = len(lines)
    if not n:
        return Lines(bounds, np.zeros(0), np.zeros((0, len(FEATURES)), np.float32))
    data, starts = _bytes_of(pa.concat_arrays([lines]))
    sizes = np.diff(starts)
    of_line = np.repeat(np.arange(n), sizes)
    counts = np.bincount(of_line * len(CLASSES) + KINDS[data], minlength=n * len(CLASSES)).reshape(n, -1)

    words = pc.ascii_split_whitespace(lines)
    flat = words.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    word_line = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())[
        there.to_numpy(zero_copy_only=False)
    ]
    flat = flat.filter(there)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    total = np.bincount(word_line, minlength=n)
    share = lambda marked: np.bincount(word_line[marked], minlength=n) / total
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (word_line[1:] == word_line[:-1])
    word_text = owner[word_line]
    pairs = np.zeros(len(codes), dtype=bool)
    pairs[1:] = word_text[1:] == word_text[:-1]
    pair_seen = np.zeros(len(codes), dtype=bool)
    at = np.flatnonzero(pairs)
    width = int(codes.max()) + 1
    pair_seen[at] = _seen_above(codes[at - 1] * width + codes[at], word_text[at])
    distinct = ~_seen_above(codes, word_line)
    line_codes = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    letters = pc.match_substring_regex(flat, r"\p{L}").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(lines, r"[.!?…][\x20\x09-\x0D]*$").to_numpy(zero_copy_only=False)
    own = np.stack(
        [
            np.log1p(sizes),
            np.log1p(total),
            np.bincount(word_line, minlength=n, weights=pc.utf8_length(flat).to_numpy()) / total,
            np.log1p(np.bincount(word_line[distinct], minlength=n)) / np.log1p(total),
            share(again),
            share(pair_seen),
            _seen_above(line_codes, owner).astype(float),
            share(~letters),
            ends.astype(float),
        ],
        axis=1,
    )
    shares = np.sqrt(counts / sizes[:, None])
    return Lines(bounds, sizes, np.concatenate([shares, own], axis=1).astype(np.float32))


def with_neighbours(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of a line, of the line above and below (0 at the ends of a text), and
    whether it is the first and the last."""
    n, width = features.shape
    wide = np.zeros((n, 3 * width + 2))
    starts, stops = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    wide[:, :width] = features
    wide[1:, width : 2 * width] = features[:-1]
    wide[:-1, 2 * width : 3 * width] = features[1:]
    wide[starts, width : 2 * width] = 0
    wide[stops - 1, 2 * width : 3 * width] = 0
    wide[starts, -2] = 1
    wide[stops - 1, -1] = 1
    return wide


class Chains:
    """Two-state chains of lines, all of them a step further at once."""

    def __init__(self, bounds: np.ndarray):
        sizes = np.diff(bounds)
        filled = np.flatnonzero(sizes)
        order = filled[np.argsort(-sizes[filled], kind="stable")]
        self.starts, self.sizes = bounds[order], sizes[order]
        # Chains that are longer than t come first.
        longest = int(self.sizes[0]) if len(order) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(longest), side="left")
        self.chain = np.zeros(int(sizes.sum()), dtype=np.int64)
        for number, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            self.chain[start : start + size] = number
        self.inner = np.ones(len(self.chain), dtype=bool)
        self.inner[self.starts] = False

    def marginals(
        self, good: np.ndarray, initial: np.ndarray, moves: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability that a line is good, expected moves between states, and the log
        normaliser of each chain, by the forward-backward method. ``good`` is what speaks
        for a good line over a bad one; ``moves[i, j]`` for ``j`` after ``i``."""
        n = len(good)
        node = np.stack([np.zeros(n), good], axis=1)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[self.starts] = node[self.starts] + initial
        for t in range(1, len(self.active)):
            at = self.starts[: self.active[t]] + t
            before = forward[at - 1]
            for state in (0, 1):
                forward[at, state] = node[at, state] + np.logaddexp(
                    before[:, 0] + moves[0, state], before[:, 1] + moves[1, state]
                )
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            after = node[at] + backward[at]
            for state in (0, 1):
                backward[at - 1, state] = np.logaddexp(
                    moves[state, 0] + after[:, 0], moves[state, 1] + after[:, 1]
                )
        ends = forward[self.starts + self.sizes - 1]
        normaliser = np.logaddexp(ends[:, 0], ends[:, 1])
        both = forward + backward
        p = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        later = np.flatnonzero(self.inner)
        expected = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                joint = forward[later - 1, i] + moves[i, j] + node[later, j] + backward[later, j]
                expected[i, j] = np.exp(joint - normaliser[self.chain[later]]).sum()
        return p, expected, normaliser


@dataclass
class LineField:
    """A fitted field. ``weights`` take standardised features of a line and its
    neighbours; ``slope`` and ``shift`` turn the log odds of a document's share of good
    lines into its score; ``prior`` is the score where there is nothing to go by."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    initial: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    shift: float = 0.0
    prior: float = 0.5

    def inputs(self, lines: Lines) -> np.ndarray:
        return with_neighbours((lines.features - self.mean) / self.scale, lines.bounds)

    def line_quality(self, lines: Lines) -> np.ndarray:
        """Probability that each line is good, given the whole text."""
        good = self.inputs(lines) @ self.weights
        return Chains(lines.bounds).marginals(good, self.initial, self.moves)[0]

    def score(self, lines: Lines, quality: np.ndarray) -> np.ndarray:
        odds = share_odds(lines, quality)
        known = np.diff(lines.bounds) > 0
        return np.where(known, 1 / (1 + np.exp(-(self.slope * odds + self.shift))), self.prior)


def share_odds(lines: Lines, quality: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted share of good lines of each text."""
    texts = len(lines.bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(lines.bounds))
    bytes_of = np.bincount(owner, weights=lines.sizes, minlength=texts)
    good = np.bincount(owner, weights=lines.sizes * quality, minlength=texts)
    share = np.clip(good / np.maximum(bytes_of, 1), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _ascend(parameters: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        slope = gradient(parameters)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        parameters = parameters + rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    return parameters


def fit_field(lines: Lines, labels: np.ndarray, prior: float) -> LineField:
    """Fit a field to texts of known quality (1 good, 0 bad); ``prior`` is the share of
    good ones among all texts.

    At first every line has the label of its text. Then lines of bad texts that the
    field holds for good count as good (but the worst line of a text), and it is fitted
    again, so that moves between good and bad lines are learned.
    """
    width = len(FEATURES)
    mean, scale = np.zeros(width), np.ones(width)
    if len(lines.features):
        mean, spread = lines.features.mean(axis=0), lines.features.std(axis=0)
        scale = np.where(spread > 1e-6, spread, 1.0)
    fitted = LineField(mean, scale, np.zeros(3 * width + 2), prior=prior)
    if len(set(labels.tolist())) < 2 or not len(lines.features):
        fitted.shift = float(np.log(prior / (1 - prior)))
        return fitted
    chains, inputs = Chains(lines.bounds), fitted.inputs(lines)
    owner = np.repeat(np.arange(len(labels)), np.diff(lines.bounds))
    truth = labels[owner].astype(float)
    count, columns = len(truth), inputs.shape[1]
    later = np.flatnonzero(chains.inner)
    for round_ in range(ROUNDS):
        observed = np.zeros((2, 2))
        np.add.at(observed, (truth[later - 1].astype(int), truth[later].astype(int)), 1)
        begun = np.bincount(truth[chains.starts].astype(int), minlength=2)

        def gradient(parameters: np.ndarray) -> np.ndarray:
            weights, initial = parameters[:columns], parameters[columns : columns + 2]
            p, expected, _ = chains.marginals(
                inputs @ weights, initial, parameters[columns + 2 :].reshape(2, 2)
            )
            first = p[chains.starts].sum()
            slope = np.concatenate(
                [
                    inputs.T @ (truth - p),
                    begun - np.array([len(chains.starts) - first, first]),
                    (observed - expected).reshape(-1),
                ]
            )
            return slope / count - PENALTY * parameters

        start = np.concatenate([fitted.weights, fitted.initial, fitted.moves.reshape(-1)])
        found = _ascend(start, gradient, STEPS, RATE)
        fitted.weights, fitted.initial = found[:columns], found[columns : columns + 2]
        fitted.moves = found[columns + 2 :].reshape(2, 2)
        quality = chains.marginals(inputs @ fitted.weights, fitted.initial, fitted.moves)[0]
        if round_ + 1 < ROUNDS:
            bad = labels[owner] == 0
            truth[bad] = quality[bad] > 0.5
            worst = np.minimum.reduceat(quality, chains.starts[np.argsort(chains.starts)])
            lowest = np.repeat(worst, np.diff(lines.bounds)[np.diff(lines.bounds) > 0])
            truth[bad & (quality <= lowest)] = 0
    _calibrate(fitted, share_odds(lines, quality), labels, np.diff(lines.bounds) > 0)
    return fitted


def _calibrate(fitted: LineField, odds: np.ndarray, labels: np.ndarray, known: np.ndarray) -> None:
    """Logistic curve from log odds to labels, which weigh as among all texts."""
    odds, labels, prior = odds[known], labels[known], fitted.prior
    weight = np.where(labels == 1, prior / max(labels.sum(), 1), (1 - prior) / max((1 - labels).sum(), 1))

    def gradient(parameters: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(parameters[0] * odds + parameters[1])))
        slope = weight * (labels - p)
        return np.array([slope @ odds, slope.sum()]) - 1e-3 * parameters

    fitted.slope, fitted.shift = (float(x) for x in _ascend(np.array([1.0, 0.0]), gradient, 500, 0.05))


def _known(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of ids labelled one way only."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )


def _sampled(known: DataFrame, documents: int) -> DataFrame:
    """The documents to fit on: for each label the first in the order of a hash."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("label = 0").orderBy(*order).limit(documents).unionByName(
        known.where("label = 1").orderBy(*order).limit(documents)
    )


def train(
    docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, most_lines: int = FIT_LINES
) -> LineField:
    """Fit a field on ``doc_id, text`` and ``doc_id, label`` (1 good, 0 bad).

    The sample is at most ``documents`` of each label with at most ``most_lines`` lines;
    only numbers that describe its lines reach the driver. Null labels and ids, and ids
    labelled both ways, are left out; of several rows of an id one counts.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", BATCH_BYTES):
                lines = line_features(part.column("text"))
                own = list(zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label"),
                        pa.array([b - a for a, b in own], pa.int64()),
                        pa.array([lines.sizes[a:b].astype("<i8").tobytes() for a, b in own], pa.binary()),
                        pa.array([lines.features[a:b].tobytes() for a, b in own], pa.binary()),
                    ],
                    names=["doc_id", "label", "n", "sizes", "features"],
                )

    known = materialize(_known(labels), "quality-labels")
    sample = _sampled(known, documents)
    bad, good = known.agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first()
    # Bounded by the size of the sample.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    described = in_batches(chosen, describe, "doc_id long, label int, n long, sizes binary, features binary")
    rows = (
        described.where(F.col("n") <= most_lines)
        .groupBy("doc_id", "label")
        .agg(F.min_by(F.struct("n", "sizes", "features"), F.xxhash64("sizes", "features")).alias("lines"))
        .select("doc_id", "label", "lines.*")
        .orderBy("doc_id")
        .collect()
    )
    lines = Lines(
        np.concatenate([[0], np.cumsum([r.n for r in rows])]).astype(np.int64),
        np.frombuffer(b"".join(bytes(r.sizes) for r in rows), "<i8"),
        np.frombuffer(b"".join(bytes(r.features) for r in rows), np.float32).reshape(-1, len(FEATURES)),
    )
    return fit_field(lines, np.array([r.label for r in rows], dtype=np.int64), (good + 1) / (good + bad + 2))


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """``doc_id, score, line_quality`` of ``doc_id, text``.

    ``line_quality`` has the probability of each line with a word to be good, given all
    lines of its text; ``score`` (0 to 1) follows from their mean weighted by bytes. A
    text without such a line, null or empty, has the model's prior as its score. Every row
    is scored, repeated ones and null ids as well; no row gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in sliced(batch, "text", BATCH_BYTES):
                lines = line_features(part.column("text"))
                quality = fitted.line_quality(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(fitted.score(lines, quality), pa.float64()),
                        pa.ListArray.from_arrays(
                            pa.array(lines.bounds, pa.int32()), pa.array(quality, pa.float32())
                        ),
                    ],
                    names=["doc_id", "score", "line_quality"],
                )

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, line_quality array<float>")
