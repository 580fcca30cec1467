"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import decontamination, language_id, packing, simhash_dedup, substring_dedup
from assayframe.llm.common import content_key, table
from assayframe.llm.url_filters import split_by_filter
from assayframe.operators.joins import checked_broadcast
from assayframe.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Below this, no language holds the larger part of the likelihood.
LEAST_LANGUAGE_SCORE = 0.5
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents in a recognised language; it replaces ``lang``."""
    model = language_id.train(docs)
    kept = language_id.predict(docs.select(COLUMNS), model).where(
        (F.col("lang_pred") != language_id.UNDETERMINED)
        & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    )
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each class of SimHash fingerprints (three words, three bits).

    The smallest id stays, a null one only where there is no other, and of several texts
    under one id the first by a hash. Of repeated rows one stays.
    """
    keyed = docs.select(*COLUMNS, *content_key(F.col("text")))
    named = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key_a", "key_b")
    prints = simhash_dedup.fingerprints(keyed.select(named.alias("doc_id"), "text"))
    rows = simhash_dedup.classes(prints).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("component_id").alias("component_id")
    )
    named_rows = materialize(
        rows.select(
            F.col("doc_id.doc_id").alias("row_id"),
            F.col("doc_id.key_a").alias("key"),
            F.col("doc_id.key_b").alias("row_b"),
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays"),
            "n",
        ).where("NOT stays OR n > 1"),
        "pipeline-copies",
    )
    # Rows stay where they are, or only those that may be copies are shuffled.
    maybe, others = split_by_filter(keyed.withColumn("key", F.col("key_a")), named_rows.select("key").distinct())
    listed = checked_broadcast(named_rows.withColumnRenamed("key", "row_a"))
    same = (
        maybe["doc_id"].eqNullSafe(listed["row_id"])
        & (maybe["key_a"] == listed["row_a"])
        & (maybe["key_b"] == listed["row_b"])
    )
    told = maybe.join(listed, same, "left")
    single = told.where("stays IS NULL").select(COLUMNS)
    repeated = told.where("stays").dropDuplicates(["doc_id", "key_a", "key_b"]).select(COLUMNS)
    return others.select(COLUMNS).unionByName(single).unionByName(repeated)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cut passages that an earlier document has; what was nothing else goes."""
    spans = materialize(substring_dedup.repeated_passages(docs), "pipeline-spans")
    kept = substring_dedup.without_passages(docs.select(COLUMNS), spans)
    return (
        kept.where(F.trim("text", F.lit(" \t\n\v\f\r")) != "")
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(COLUMNS)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    found = decontamination.contaminated(docs, table(spark, folder, "benchmark"))
    keys = found.select("text_key").distinct()
    return docs.join(keys, F.xxhash64(docs["text"]) == keys["text_key"], "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the remaining documents in full sequences."""
    return packing.pack(docs, TOKENIZER, END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
# Language scores and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Null and empty texts, and those without a letter, have no language and go with the
    first stage. Rows of one id with different texts are documents of their own; of
    repeated rows one stays. Without documents there are no pieces. Further columns of
    ``documents`` have no part in it.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
