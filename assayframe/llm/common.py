"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What is handed to Python at once: so many rows, or bytes; one longer text is a batch.
BATCH_ROWS, BATCH_BYTES = 50_000, 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def folded_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased, as UTF-8.

    ``bytes`` lower-cases and splits by ASCII alone, which is what is wanted.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, so that texts need not be shuffled."""
    whole = F.coalesce(text, F.lit(""))
    return [
        F.xxhash64(F.lit("a"), whole).alias("key_a"),
        F.xxhash64(whole, F.lit("b")).alias("key_b"),
    ]


def in_batches(
    frame: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that whole texts fit. The
    bounds are settings of the session, the same for all operators."""
    settings = frame.sparkSession.conf
    settings.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    settings.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(function, schema)


def in_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or little more, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
