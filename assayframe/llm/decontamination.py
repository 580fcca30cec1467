"""Benchmark passages in documents, by SimHash windows; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.sources.scratch import materialize

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 16, 8, 8
# Of 16 differing bits at most 2 fall into one of 8 blocks.
BLOCK_RADIUS = RADIUS // BLOCKS
# Shingles of the benchmark up to this number are sent to all executors, some 50 MB.
BROADCAST_SHINGLES = 500_000
LOW = 0xFFFFFFFF


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_at(words: Column, place: Column) -> Column:
    """Hash of the five words from a place (from 0) on."""
    return F.xxhash64(*(F.get(words, place + i) for i in range(SHINGLE)))


def _shingled(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """A row per shingle; none for fewer than five words."""
    return (
        rows.where(F.size(words) >= SHINGLE)
        .select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - SHINGLE)).alias("place"))
        .select(*keep, words, "place", shingle_at(F.col(words), F.col("place")).alias("shingle"))
    )


def fingerprints(rows: DataFrame, words: str, *keys: str) -> DataFrame:
    """``keys`` and ``fingerprint``: SimHash of the words, repeats weighing more.

    Two bits are counted in one sum, 32 bits apart.
    """
    pair = F.lit(0x0000000100000001).cast("long")
    hashed = rows.select(*keys, F.explode(words).alias("word")).withColumn("hash", F.xxhash64("word"))
    sums = [
        F.sum(F.shiftrightunsigned("hash", bit).bitwiseAND(pair)).alias(f"s{bit}") for bit in range(32)
    ]
    counted = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = []
    for bit in range(32):
        low = F.col(f"s{bit}").bitwiseAND(F.lit(LOW).cast("long")) * 2 > F.col("n")
        high = F.shiftrightunsigned(f"s{bit}", 32) * 2 > F.col("n")
        bits.append(F.when(low, F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(0))
        bits.append(F.when(high, F.shiftleft(F.lit(1).cast("long"), bit + 32)).otherwise(0))
    return counted.select(*keys, reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def _block(fingerprint: Column, block: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * block).bitwiseAND((1 << BLOCK_BITS) - 1)


def near_fingerprints(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of ``window`` and ``item_id`` of equal ``size`` with fingerprints within
    the radius. Some block of any such pair differs in at most two bits, and the
    items are listed under all block values so near to theirs."""
    masks = [
        sum(1 << bit for bit in bits)
        for n in range(BLOCK_RADIUS + 1)
        for bits in combinations(range(BLOCK_BITS), n)
    ]
    listed = items.select(
        "item_id",
        "size",
        F.col("fingerprint").alias("item_print"),
        F.posexplode(F.array(*(_block(F.col("fingerprint"), b) for b in range(BLOCKS)))).alias("block", "value"),
    ).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    listed = listed.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    probing = windows.select(
        "window",
        "size",
        "fingerprint",
        F.posexplode(F.array(*(_block(F.col("fingerprint"), b) for b in range(BLOCKS)))).alias("block", "value"),
    )
    return (
        probing.join(listed, ["size", "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("window", "item_id")
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_key, item_id, first_word, similarity`` of each benchmark item of which a
    document has a window with as many words and a weighted similarity of 0.8 or more:
    shared over all occurrences of five-word shingles. The most similar window is
    given, of equal ones the first.

    A window that similar shares a shingle with the item. So a join on shingles gives
    the places where item-sized windows are laid, aligned by that shingle; equal
    windows are judged once. Windows and items with fingerprints within 16 of 64 bits
    are compared exactly.

    Items of fewer than five words never match, nor do null and empty texts. Rows that
    repeat count once; a null doc_id is returned as such. ``text_key`` is the hash of the
    text, for rows that share an id.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where(
        F.size("item_words") >= SHINGLE
    )
    items = materialize(items.distinct().withColumn("size", F.size("item_words")), "leak-items")
    anchors = materialize(
        _shingled(items, "item_words", "size").select("shingle", "size", "place").distinct(), "leak-shingles"
    )
    if anchors.count() <= BROADCAST_SHINGLES:
        anchors = F.broadcast(anchors)
    anchors = anchors.withColumnRenamed("place", "item_place")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    first = F.greatest(F.col("place") - F.col("item_place"), F.lit(0))
    laid = (
        _shingled(texts, "words", "doc_id", "text_key")
        .join(anchors, "shingle")
        .select("doc_id", "text_key", "size", first.alias("first_word"), "words")
        .withColumn("window", F.array_join(F.slice("words", F.col("first_word") + 1, F.col("size")), " "))
        .select("doc_id", "text_key", "size", "first_word", "window")
        .distinct()
    )
    laid = materialize(laid, "leak-windows")
    windows = materialize(
        laid.select("window", "size").distinct().withColumn("words", F.split("window", " ")), "leak-distinct"
    )
    near = near_fingerprints(
        fingerprints(windows, "words", "window", "size"),
        fingerprints(items, "item_words", "item_id", "size"),
    )
    counts = lambda rows, words, *keys: (
        _shingled(rows, words, *keys).groupBy(*keys, "shingle").agg(F.count(F.lit(1)).alias("n"))
    )
    of_items = counts(items, "item_words", "item_id", "size").withColumnRenamed("n", "item_n")
    of_windows = counts(windows, "words", "window", "size")
    length = F.size(F.split("window", " "))
    shared = (
        near.join(of_windows, "window")
        .join(of_items, ["item_id", "size", "shingle"])
        .groupBy("window", "size", "item_id")
        .agg(F.sum(F.least("n", "item_n")).alias("shared"))
        .withColumn("all", length + F.col("size") - 2 * (SHINGLE - 1) - F.col("shared"))
        .withColumn("similarity", F.col("shared") / F.col("all"))
        .where(F.col("similarity") >= SIMILARITY)
        .select("window", "size", "item_id", "similarity")
    )
    found = materialize(shared, "leak-matches")
    best = F.struct(F.col("similarity"), (-F.col("first_word")).alias("first"))
    return (
        laid.join(found, ["window", "size"])
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(best).alias("best"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            (-F.col("best.first")).alias("first_word"),
            F.col("best.similarity").alias("similarity"),
        )
    )
