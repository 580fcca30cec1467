"""Which source of a dataset to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import source_prefix
from assayframe.operators.joins import first_per_key

DATASET = ("cohort", "data_type")


def listed_sources(lists: DataFrame) -> DataFrame:
    """Sources of the first list row ``(cohort, data_type, list_ord, sources)``
    of each dataset, in listed order."""
    first = first_per_key(lists, DATASET, ["list_ord"])
    return first.select(*DATASET, F.posexplode("sources").alias("priority", "source"))


def available_sources(candidates: DataFrame, file_index: DataFrame) -> DataFrame:
    """Candidates with a file of theirs in the index; all of a dataset's
    candidates when none has one.

    A file belongs to a source if its name starts with the source's prefix.
    Every prefix ends with a dash, so the file names are cut at their dashes and
    matched by equality: no pairs are compared.
    """
    parts = F.split("filename", "-")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("_parts") - 1),
        lambda n: F.concat(F.array_join(F.slice("_parts", F.lit(1), n), "-"), F.lit("-")),
    )
    starts = (
        file_index.select(parts.alias("_parts"))
        .filter(F.size("_parts") > 1)
        .select(F.explode(cuts).alias("_prefix"))
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    prefix = source_prefix(F.col("source"), F.col("cohort"), F.col("data_type"))
    marked = candidates.withColumn("_prefix", prefix).join(starts, "_prefix", "left")
    usable = marked.groupBy(*DATASET).agg(F.max("_listed").alias("_any"))
    return (
        marked.join(usable, list(DATASET))
        .filter(F.col("_listed") | F.col("_any").isNull())
        .select(*candidates.columns)
    )


def first_available(attempts: DataFrame) -> DataFrame:
    """First access method, then first source, that yields a table.

    ``attempts`` has ``(cohort, data_type, method, method_priority, source,
    source_priority, available)``.
    """
    return first_per_key(
        attempts.filter("available"), DATASET, ["method_priority", "source_priority"]
    ).select(*DATASET, "method", "source")
