"""Packing of documents into sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import in_batches, in_blocks
from assayframe.llm.tokens import BLOCK_BYTES, encoder_of, read_definition
from assayframe.sources.scratch import materialize

# Hashed token counts, their random projection, and the bits kept of each dimension.
HASHED, DIMENSIONS, BITS = 256, 4, 12
PROJECTION_SEED = 7
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below
    ``2 ** bits``. Rows and curve are turned axis by axis, from the top bit down."""
    axes = points.T.astype(np.int64).copy()
    n = len(axes)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = level - 1
        for i in range(n):
            inverted = (axes[i] & level) != 0
            swapped = np.where(inverted, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(inverted, axes[0] ^ below, axes[0] ^ swapped)
            if i:
                axes[i] ^= swapped
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], dtype=np.int64)
    level = top
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    axes ^= turn
    keys = np.zeros(axes.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | ((axis >> bit) & 1)
    return keys


def _projection() -> np.ndarray:
    return np.random.default_rng(PROJECTION_SEED).standard_normal((HASHED, DIMENSIONS))


def _buckets(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed & np.uint64(HASHED - 1)).astype(np.int64)


# Of all ids of two bytes.
_SHORT_BUCKETS = _buckets(np.arange(1 << 16))


def curve_keys(documents: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents by their token ids."""
    vectors = np.zeros((len(documents), HASHED))
    for row, ids in zip(vectors, documents):
        buckets = _SHORT_BUCKETS[ids] if ids.itemsize == 2 else _buckets(ids)
        row[:] = np.sqrt(np.bincount(buckets, minlength=HASHED))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / np.maximum(norms, 1e-12) @ projection
    # About normal, so that this spreads them over the unit interval.
    unit = 1 / (1 + np.exp(-1.7 * flat))
    cells = np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def _encode(definition, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        end, projection = encoder.id_bytes([end_id]), _projection()
        for batch in in_blocks(batches, BLOCK_BYTES):
            encoded = [x + end for x in encoder.encode_all(batch.column("text"))]
            keys = curve_keys([np.frombuffer(x, encoder.dtype) for x in encoded], projection)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) // len(end) for x in encoded], pa.int64()),
                    pa.array(encoded, pa.binary()),
                ],
                names=["doc_id", "tie", "key", "n", "ids"],
            )

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and the number of ids before each row in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column("n").to_numpy()
        ends = at + np.cumsum(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(counts), part), pa.int32()),
                pa.array(ends - counts, pa.int64()),
                batch.column("doc_id"),
                batch.column("n"),
                batch.column("ids"),
            ],
            names=["part", "at", "doc_id", "n", "ids"],
        )
        at = int(ends[-1]) if len(ends) else at


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            for row in batch.to_pylist():
                n, begin = row["n"], row["base"] + row["at"]
                wide = np.frombuffer(row["ids"], f"<u{len(row['ids']) // n}").astype("<u4").tobytes()
                done = 0
                while done < n:
                    sequence, offset = divmod(begin + done, length)
                    size = min(n - done, length - offset)
                    for name, value in zip(
                        columns,
                        (row["doc_id"], done, size, n, sequence, offset, wide[4 * done : 4 * (done + size)]),
                    ):
                        columns[name].append(value)
                    done += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in columns.items()],
                names=list(columns),
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: ``doc_id, start, length,
    doc_tokens, sequence_id, offset, ids`` (four-byte little-endian).

    Documents are put in the order of a Hilbert curve through a projection of their
    hashed token counts, so that neighbours in a sequence are alike, and their ids
    are cut where a sequence is full. Only the very last sequence is padded. Null and
    empty texts are one ``end_id``; equal documents follow each other by a hash of id
    and text, so that many copies are dealt over several tasks; repeated rows stay.

    Ids are written once before and once after the range sort: the first so that
    sampling its bounds doesn't encode again, the second because the place of a
    document is known only when all lower partitions have been counted.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer_path))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("tie")
    )
    encoded = materialize(
        in_batches(
            keyed, _encode(definition, end_id), "doc_id long, tie long, key long, n long, ids binary"
        ),
        "packing-encoded",
    )
    dealt = encoded.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    placed = materialize(
        in_batches(dealt, _offsets, "part int, at long, doc_id long, n long, ids binary"), "packing-placed"
    )
    # A row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("part")
        .agg(F.sum("n").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    return in_batches(placed.join(F.broadcast(bases), "part"), _cut(length), PIECES)
