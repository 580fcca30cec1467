"""Runs of periodic words in texts, and texts without their repeated periods."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import in_batches

# A run has at least this many words, and as many whole periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Bytes of text that are split into words at once.
BATCH_BYTES = 8 << 20
# Stretches are cut again as long as a round takes away this share of their words.
WORTHWHILE = 0.05
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def squares(words: Sequence[int]) -> Iterator[tuple[int, int]]:
    """``(end, period)`` of squares among the words, by ascending end.

    Words are appended one by one to a suffix automaton. Its suffix links are a tree
    whose paths to the root are the suffixes of what has been read; preferred paths
    hold the states that last occurred at the same end, each as a splay tree with that
    end (``colour``) at its top. An appended word accesses its path: every segment on
    the way gets the new end, and the distance from its previous one is the period of a
    square if the segment's longest suffix is at least as long. A primitive root
    occurs in its square only at both ends, so that every primitive square is told.

    Memory grows with the words, by some 0.3 kilobytes each.
    """
    size = 2 * len(words) + 2
    zeros = bytes(size * 4)
    # States; the first outgoing word of a state lies in two columns, others in a dictionary.
    length, link, target = array("i", zeros), array("i", zeros), array("i", zeros)
    symbol, more = array("i", b"\xff" * len(zeros)), {}
    # Splay trees, 0 for none; the root of one points to the parent of its path's top.
    up, left, right, colour = (array("i", zeros) for _ in range(4))

    def splay(x: int) -> None:
        """Make a state the root of its splay tree."""
        p = up[x]
        while p:
            from_left = left[p] == x
            if not from_left and right[p] != x:
                return
            g = up[p]
            p_left = g and left[g] == p
            if not (p_left or (g and right[g] == p)):
                top = p
                g = 0
            else:
                top = g
            beyond = up[top]
            if not g:
                _rotate(x, p, from_left)
            elif p_left == from_left:
                _rotate(p, g, p_left)
                _rotate(x, p, from_left)
            else:
                _rotate(x, p, from_left)
                _rotate(x, g, p_left)
            up[x] = beyond
            if beyond and left[beyond] == top:
                left[beyond] = x
            elif beyond and right[beyond] == top:
                right[beyond] = x
            else:
                colour[x] = colour[top]
                return
            p = beyond

    def _rotate(x: int, p: int, from_left: bool) -> None:
        """Lift a child above its parent."""
        if from_left:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            up[inner] = p
        up[p] = x

    def clone_of(q: int, p: int, word: int, state: int) -> None:
        """Part the shorter suffixes of a state off, as its new parent in the tree."""
        length[state] = length[p] + 1
        symbol[state], target[state], link[state] = symbol[q], target[q], link[q]
        if q in more:
            more[state] = more[q].copy()
        while p >= 0:
            if symbol[p] == word:
                if target[p] != q:
                    break
                target[p] = state
            elif more.get(p, {}).get(word) == q:
                more[p][word] = state
            else:
                break
            p = link[p]
        link[q] = state
        # Both last occurred at the same end: the parent joins the path just above.
        splay(q)
        above = left[q]
        left[state], left[q], up[state] = above, state, q
        if above:
            up[above] = state

    link[0] = -1
    states, last = 1, 0
    for end, word in enumerate(words):
        state, states = states, states + 1
        length[state] = length[last] + 1
        p, q = last, -1
        while p >= 0:
            first = symbol[p]
            if first == word:
                q = target[p]
                break
            if first < 0:
                symbol[p], target[p] = word, state
            elif p not in more:
                more[p] = {word: state}
            else:
                q = more[p].setdefault(word, state)
                if q != state:
                    break
                q = -1
            p = link[p]
        if q < 0:
            link[state] = 0
        elif length[q] == length[p] + 1:
            link[state] = q
        else:
            clone, states = states, states + 1
            clone_of(q, p, word, clone)
            link[state] = clone
        last = below = state
        x = link[state]
        while x:
            splay(x)
            previous = colour[x]
            if end - previous <= length[x]:
                yield end, end - previous
            longer = right[x]
            if longer:
                colour[longer] = previous
            right[x], up[below] = below, x
            below, x = x, up[x]
        up[below], colour[below] = 0, end


def runs(
    words: Sequence[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a sequence, by start and period:
    the widest stretches with that smallest period, ``least_words`` long and
    ``least_periods`` (2 or more) periods long at least. Every square is extended once."""
    n, reach, found = len(words), {}, {}
    for end, period in squares(words):
        if reach.get(period, -1) >= end:
            continue
        start, stop = end - 2 * period + 1, end + 1
        while start > 0 and words[start - 1] == words[start - 1 + period]:
            start -= 1
        while stop < n and words[stop] == words[stop - period]:
            stop += 1
        reach[period] = stop - 1
        if stop - start >= max(least_words, least_periods * period):
            # A multiple of the smallest period spans the same stretch.
            found[start, stop] = min(period, found.get((start, stop), period))
    return sorted(
        ((start, stop - start, period) for (start, stop), period in found.items()),
        key=lambda run: (run[0], run[2]),
    )


def stretches(
    codes: np.ndarray, owner: np.ndarray, least_words: int, least_periods: int
) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches that can hold runs. In a run every word
    occurs ``least_periods`` times at least, so words that are rarer in their text, then
    in their stretch, part stretches; those that are too short go."""
    at, group = np.arange(len(codes)), owner
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        _, which, times = np.unique(group * width + codes[at], return_inverse=True, return_counts=True)
        kept = at[times[which] >= least_periods]
        first = np.ones(len(kept), dtype=bool)
        first[1:] = (np.diff(kept) > 1) | (np.diff(owner[kept]) != 0)
        group = np.cumsum(first) - 1
        long_enough = np.bincount(group, minlength=1)[group] >= least_words
        before, at, group = len(at), kept[long_enough], group[long_enough]
        if len(at) > (1 - WORTHWHILE) * before:
            break
    if not len(at):
        return at, at
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return at[first], at[np.append(first[1:] - 1, len(at) - 1)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
    # White space at the ends of a text leaves empty words.
    filled = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled), counts[np.concatenate([[0], np.cumsum(sizes)])]


def _examined(texts: pa.Array, least_words: int, least_periods: int) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, bounds = words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    kept = np.ones(len(codes), dtype=bool)
    found: list[list] = [[] for _ in range(len(texts))]
    for first, last in zip(*(x.tolist() for x in stretches(codes, owner, least_words, least_periods))):
        text = int(owner[first])
        for start, length, period in runs(codes[first : last + 1].tolist(), least_words, least_periods):
            start += first
            kept[start + period : start + length] = False
            found[text].append({"start": start - int(bounds[text]), "length": length, "period": period})
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    left = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.filter(pa.array(kept)))
    return [
        pa.array(np.diff(bounds), pa.int64()),
        pa.array(found, pa.list_(RUN)),
        pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string()),
    ]


def sliced(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of a text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for first, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(first, stop - first)


def periodic_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to ``doc_id, text`` (the text goes,
    further columns, too).

    ``runs`` lists ``start, length, period`` in words of the whole text, by start and
    period; see :func:`runs`. ``collapsed`` has the words that no run contains after
    its first period, joined by one blank. Words lie between ASCII white space and are
    equal if their bytes are. Null texts have no words, like empty ones; repeated rows
    and null ids stay rows of their own; no row gives no rows. Nothing is shuffled:
    a text is one row, of any length.
    """

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", BATCH_BYTES):
                columns = _examined(part.column("text"), least_words, least_periods)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], names=["doc_id", "n_words", "runs", "collapsed"]
                )

    return in_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        examine,
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>,"
        " collapsed string",
    )
