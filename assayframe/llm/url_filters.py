"""Url rules found by a blocked Bloom filter and confirmed by a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import ascii_lower
from assayframe.sources.scratch import materialize

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# A block is one 64-bit word; with four listed keys to a block about one absent key
# in fifty passes. The filter is at most this many words, 2 MB when broadcast:
# beyond some half a million listed keys more pass it, and the join still decides.
LARGEST_FILTER = 1 << 17
KEYS_A_BLOCK = 4
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A to Z
    lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """Four of 64 bits, from a hash that is independent of the block's."""
    seed = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bits = None
    for shift in (0, 6, 12, 18):
        # shiftleft takes its distance as an integer column in SQL only.
        place = F.shiftrightunsigned(seed, shift).bitwiseAND(63).cast("int")
        bit = F.call_function("shiftleft", one, place)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def blocked_filter(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """Words of the filter, ``(block, word)``, and the number of blocks."""
    wanted = max(1, keys.count() // KEYS_A_BLOCK)
    blocks = min(LARGEST_FILTER, 1 << (wanted - 1).bit_length())
    words = (
        keys.select(_block(F.col(key), blocks).alias("block"), _bits(F.col(key)).alias("bits"))
        .groupBy("block")
        .agg(F.bit_or("bits").alias("word"))
    )
    return words, blocks


def split_by_filter(rows: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be listed, all that are and few others; and the other rows."""
    words, blocks = blocked_filter(keys, key)
    passes = F.col("word").bitwiseAND(_bits(F.col(key))) == _bits(F.col(key))
    blocked = rows.withColumn("block", _block(F.col(key), blocks))
    hits = blocked.join(F.broadcast(words), "block").where(passes)
    others = blocked.join(F.broadcast(words), "block", "left").where(~F.coalesce(passes, F.lit(False)))
    return hits.drop("block", "word"), others.drop("block", "word")


def possible_hits(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key may be listed: all that are, and few others."""
    return split_by_filter(rows, keys, key)[0]


def listed_rules(rules: DataFrame) -> DataFrame:
    """One row per rule; of contradicting rows the blocking one holds, a row with
    a null in it doesn't count."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("key", F.concat("rule_host", "rule_path"))
    )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``page_id, url``.

    ``rules`` hold ``host, path, verdict`` (``allow`` or ``block``). A rule fits its
    host and all subdomains where the url's path starts with the rule's; the longest
    decides, of equal ones that with the longer host. Urls without a rule are not
    listed and get ``otherwise``, with a null rule. Null urls have an empty host and
    path; repeated rows stay; without rules every url is unlisted.

    Each distinct host and path is looked up once. Only host endings and path
    beginnings of lengths that some rule has are looked up.
    """
    listed = materialize(listed_rules(rules), "url-rules")
    located = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    labels = F.size(F.split("rule_host", r"\."))
    # Distinct pairs of small numbers: bounded by the longest host and path listed.
    shapes = listed.select(labels.alias("n"), F.length("rule_path").alias("m")).distinct().collect()
    candidates = [
        F.when(
            F.length("path") >= s["m"],
            F.concat(F.substring_index("host", ".", -s["n"]), F.substring("path", 1, s["m"])),
        )
        for s in shapes
    ]
    looked_up = (
        located.distinct()
        if not candidates
        else located.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_distinct(F.array(*candidates))).alias("key"))
        .where("key IS NOT NULL AND host <> ''")
    )
    if not candidates:
        return located.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")
        )
    confirmed = possible_hits(looked_up, listed).join(listed, "key")
    rank = F.struct(F.length("key"), F.length("rule_host"))
    decided = materialize(
        confirmed.groupBy("host", "path").agg(
            F.max_by("key", rank).alias("rule"), F.max_by("rule_verdict", rank).alias("verdict")
        ),
        "url-decisions",
    )
    return located.join(decided, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(otherwise)).alias("verdict"),
    )
