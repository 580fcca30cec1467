"""Near-duplicate classes by SimHash fingerprints within three bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import folded_words, in_batches
from assayframe.sources.scratch import materialize

RADIUS = 3
# The 64 bits fall into two halves of 16 segments of two bits each.
SEGMENTS = 16
# Members of one cell that a task compares with each other; more are split.
CELL_ROWS = 4096
# Cells up to this size are compared row by row over a whole batch at once.
SMALL_CELL = 32
SHINGLE_SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SHINGLE_SEED)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; of fewer words the whole sequence."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    return np.fromiter(map(_hash, shingles(folded_words(text), size)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half the hashes have it; zero without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        octets = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits as a long) of each row's whole text.

    A null or empty text has the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint long")


def segment_counts(half: Column) -> Column:
    """Set bits (0 to 2) of each two-bit segment, in two bits each."""
    mask = F.lit(0x55555555).cast("long")
    return half.bitwiseAND(mask) + F.shiftright(half, 1).bitwiseAND(mask)


def cells_of(prints: DataFrame) -> DataFrame:
    """``cell, home, fingerprint``: the grid cells in which a fingerprint is met.

    The Manhattan distance of the segment counts is at most the number of differing
    bits. Where three bits differ, at most one does in one of the halves, and then
    the counts of that half are equal or differ by one in one segment. So it is
    enough that each fingerprint lies at home in the cell of its counts and visits
    those one step up.
    """
    fingerprint, low = F.col("fingerprint"), F.lit(0xFFFFFFFF).cast("long")
    met = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(fingerprint, 32).bitwiseAND(low) if half else fingerprint.bitwiseAND(low)
        counts = segment_counts(bits)
        # The counts leave the topmost of 64 bits free for the half.
        name = lambda c, half=half: c * 2 + half
        met.append(F.struct(name(counts).alias("cell"), F.lit(True).alias("home")))
        for segment in range(SEGMENTS):
            step = F.lit(1 << (2 * segment)).cast("long")
            full = F.shiftright(counts, 2 * segment).bitwiseAND(3) == 2
            met.append(
                F.when(~full, F.struct(name(counts + step).alias("cell"), F.lit(False).alias("home")))
            )
    return (
        prints.select("fingerprint", F.explode(F.array(*met)).alias("met"))
        .where("met IS NOT NULL")
        .select("met.cell", "met.home", "fingerprint")
    )


def _split_hot(cells: DataFrame) -> DataFrame:
    """Add ``part``: cells with many homes are split into blocks, and each row goes to
    the pairs of its block with every block, so that any two rows still meet."""
    hot = materialize(
        cells.where("home")
        .groupBy("cell")
        .agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"))
        .where("blocks > 1"),
        "simhash-hot-cells",
    )
    if hot.isEmpty():
        return cells.withColumn("part", F.lit(0))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return (
        cells.join(hot, "cell", "left")
        .select("*", other.alias("other"))
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn(
            "part", F.least("own", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("own", "other")
        )
        .drop("blocks", "own", "other")
    )


def spanning_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints which chains of links within the radius join:
    a search from each, over what none has reached yet."""
    left, right, rest = [], [], np.unique(prints)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= RADIUS
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), at))
            right.append(found)
            front.extend(found)
    if not left:
        return rest, rest
    return np.concatenate(left), np.concatenate(right)


def links_of_cells(keys: np.ndarray, home: np.ndarray, prints: np.ndarray):
    """Links among rows sorted by key. Small cells: rows at each distance from one
    another, over all cells at once. Large ones: spanning links."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(keys)])
    useful = (sizes > 1) & np.logical_or.reduceat(home, starts)
    left, right = [], []
    rows = np.flatnonzero(np.repeat(useful & (sizes <= SMALL_CELL), sizes))
    group = np.repeat(np.arange(len(starts)), sizes)[rows]
    for away in range(1, SMALL_CELL):
        together = np.flatnonzero(group[away:] == group[:-away])
        if not len(together):
            break
        a, b = prints[rows[together]], prints[rows[together + away]]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        left.append(a[near])
        right.append(b[near])
    for at in np.flatnonzero(useful & (sizes > SMALL_CELL)):
        a, b = spanning_links(prints[starts[at] : starts[at] + sizes[at]])
        left.append(a)
        right.append(b)
    if not left:
        return prints[:0], prints[:0]
    return np.concatenate(left), np.concatenate(right)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by cell and part; a cell may go on in the next batch."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        a, b = links_of_cells(rows[:, :2], rows[:, 2] == 1, rows[:, 3].copy().view(np.uint64))
        low, high = (f(a.view(np.int64), b.view(np.int64)) for f in (np.minimum, np.maximum))
        pairs = np.unique(np.stack([low, high], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "home", "fingerprint")]
        rows = np.stack([c.astype(np.int64) for c in columns], axis=1)
        held.append(rows)
        if (rows[0, :2] == rows[-1, :2]).all():
            continue
        rows = np.concatenate(held)
        # The last cell may not be complete.
        cut = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1
        held = [rows[cut:]]
        yield flush(rows[:cut])
    if held:
        yield flush(np.concatenate(held))


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links within the radius that join the distinct ``fingerprint``
    values as all such links do."""
    rows = _split_hot(cells_of(prints))
    dealt = rows.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return in_batches(dealt.select("cell", "part", "home", "fingerprint"), _compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``a, b``: the least node that each reaches.

    Each round takes the least label among neighbours, then the label of the label,
    until the sum of the labels no longer falls. Tables are written in between, so
    that hot nodes are split by the joins and lost executors cost one step.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "graph-edges"
    )
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    )
    labels = materialize(labels, "graph-labels")
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    last = labels.agg(total).first()[0]
    while last is not None:
        told = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        lower = told.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        lower = materialize(lower, "graph-labels")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(
            lower.join(up, "component").select("node", F.least("component", "next").alias("component")),
            "graph-labels",
        )
        now = labels.agg(total).first()[0]
        if now == last:
            break
        last = now
    return labels


def classes(prints: DataFrame) -> DataFrame:
    """Rows of ``doc_id, fingerprint`` with ``component_id``: the smallest doc_id that
    links of at most three differing bits reach, the row's own included.

    Equal fingerprints are one node. Fingerprints of nothing (zero) link like any
    other. Null ids are never a component_id unless no other is reachable; repeated
    rows stay; an empty table has no rows.
    """
    prints = materialize(prints, "simhash-prints")
    nodes = materialize(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes"
    )
    edges = links(nodes.select("fingerprint"))
    reached = components(edges).withColumnRenamed("node", "fingerprint")
    # Nodes without a link are their own component.
    owned = materialize(
        nodes.join(reached, "fingerprint", "left").select(
            "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
        ),
        "simhash-owned",
    )
    least = owned.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(owned.join(least, "component").select("fingerprint", "component_id"), "simhash-named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
