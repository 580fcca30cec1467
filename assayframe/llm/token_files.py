"""Token ids in flat binary files with document offsets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import in_batches, in_blocks
from assayframe.llm.tokens import BLOCK_BYTES, encoder_of, read_definition
from assayframe.sources.scratch import materialize, scratch_path

MAGIC = b"TOKENS01"
MANIFEST = "part int, file string, width int, docs long, tokens long"
DOCS_READ = 256


def _write_index(out, counts: list[int], ids: list[int | None]) -> None:
    """Header; n + 1 offsets in ids; n document ids; n bytes that are 0 for a null id."""
    offsets = np.concatenate([[0], np.cumsum(counts, dtype="<u8")]).astype("<u8")
    out.write(MAGIC)
    out.write(np.array([len(counts)], "<u8").tobytes())
    out.write(offsets.tobytes())
    out.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
    out.write(np.array([i is not None for i in ids], "u1").tobytes())


def _read_index(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if raw[:8] != MAGIC:
        raise ValueError("not an index of token files")
    n = int(np.frombuffer(raw, "<u8", 1, 8)[0])
    offsets = np.frombuffer(raw, "<u8", n + 1, 16)
    ids = np.frombuffer(raw, "<i8", n, 16 + 8 * (n + 1))
    return offsets, ids, np.frombuffer(raw, "u1", n, 16 + 8 * (2 * n + 1)).astype(bool)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``folder/*.bin`` and ``*.idx`` and return the manifest of what counts:
    ``part, file, width, docs, tokens, base``.

    Documents go in ascending ``doc_id`` (nulls first, equal ids by a hash of their
    text), each with ``end_id`` at its end. A file holds the unsigned little-endian
    ids of one partition, two bytes wide where the vocabulary allows, else four; its
    index the 64-bit offsets. ``base`` is the number of ids in lower partitions. Null
    and empty texts are an end alone. Attempts that failed may leave files behind
    that no manifest names. ``folder`` must be one that all executors reach.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        end = encoder.id_bytes([end_id])
        store, place = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        width = len(end)
        counts: list[int] = []
        ids: list[int | None] = []
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/{name}.bin") as out:
            for batch in in_blocks(batches, BLOCK_BYTES):
                encoded = encoder.encode_all(batch.column("text"))
                out.write(b"".join(x for one in encoded for x in (one, end)))
                counts += [len(one) // width + 1 for one in encoded]
                ids += batch.column("doc_id").to_pylist()
        if not counts:
            return
        with store.open_output_stream(f"{place}/{name}.idx") as out:
            _write_index(out, counts, ids)
        row = [[part], [name], [width], [len(counts)], [sum(counts)]]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "file", "width", "docs", "tokens"]
        )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "tie", F.xxhash64("text")
    )
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = materialize(in_batches(dealt.select("doc_id", "text"), run, MANIFEST), "token-manifest")
    # A row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return materialize(manifest.withColumn("base", base), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files of a manifest.

    ``ids`` are four-byte little-endian numbers. Local files are mapped into memory,
    others read document by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            with store.open_input_file(f"{place}/{row['file']}.idx") as source:
                offsets, ids, given = _read_index(source.read())
            kind = f"<u{row['width']}"
            local = isinstance(store, fs.LocalFileSystem)
            if local:
                flat = np.memmap(f"{place}/{row['file']}.bin", dtype=kind, mode="r")
            else:
                source = store.open_input_file(f"{place}/{row['file']}.bin")
            for first in range(0, len(ids), DOCS_READ):
                last = min(len(ids), first + DOCS_READ)
                low, high = int(offsets[first]), int(offsets[last])
                if local:
                    part = flat[low:high]
                else:
                    part = np.frombuffer(source.read_at((high - low) * row["width"], low * row["width"]), kind)
                wide = part.astype("<u4").tobytes()
                at = (offsets[first : last + 1] - offsets[first]).astype(np.int64) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first:last], mask=~given[first:last]),
                        pa.array(offsets[first:last].astype(np.int64) + row["base"]),
                        pa.array(np.diff(at) // 4),
                        pa.array([wide[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    files = manifest.count()
    # Each file is a task of its own.
    dealt = manifest.repartition(max(1, files)) if files > 1 else manifest
    return in_batches(dealt, run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark) -> str:
    """A fresh folder in the cluster's shared one."""
    return scratch_path(spark, "tokens")
