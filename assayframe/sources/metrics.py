"""Metrics files of earlier runs, CSV or JSON, from any number of run folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import k_from_run_dir, null_if_nan, strip
from assayframe.operators.ranking import sliced_position
from assayframe.sources.scratch import materialize

# Names of metrics files. A CSV written by Spark is a folder of
# that name with part files.
METRICS_CSV = r"(?i)/metrics[^/]*\.csv(/part-[^/]*)?$"
METRICS_JSON = r"(?i)/metrics[^/]*\.json$"
# The same for listing, where only the last part of a path counts.
CSV_NAMES = "{[mM][eE][tT][rR][iI][cC][sS]*.[cC][sS][vV],part-*}"
JSON_NAMES = "[mM][eE][tT][rR][iI][cC][sS]*.[jJ][sS][oO][nN]"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
RAW_FIELDS = ("rf_r2", "r2", "rf_mae", "mae", "rmse")


def metrics_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``(path, run_dir, kind)`` of the metrics files below run folders.

    ``roots`` are absolute folders or glob patterns; the matched folder is cut
    out of each path by its depth and names the run. Roots that match nothing are
    passed over.
    """
    if not roots:
        raise ValueError("no run folders given")
    found = None
    for root in roots:
        bare = root.rstrip("/")
        depth = len(_without_scheme(bare).split("/"))
        if not _exists(spark, bare):
            continue
        listed = _listed(spark, bare).select("path")
        tail = F.regexp_replace("path", _SCHEME, "")
        run_dir = F.substring_index(F.substring_index(tail, "/", depth), "/", -1)
        named = listed.select("path", run_dir.alias("run_dir"))
        found = named if found is None else found.unionByName(named)
    if found is None:
        raise RuntimeError("no metrics files found")
    kind = F.when(F.col("path").rlike(METRICS_CSV), "csv").when(
        F.col("path").rlike(METRICS_JSON), "json"
    )
    return found.distinct().withColumn("kind", kind).filter(F.col("kind").isNotNull())


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _exists(spark: SparkSession, root: str) -> bool:
    """Whether a folder or pattern matches anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _without_scheme(path: str) -> str:
    import re

    bare = re.sub(_SCHEME, "", path)
    if not bare.startswith("/"):
        raise ValueError(f"run folders have to be absolute: {path}")
    return bare


def _read_path() -> Column:
    """Path of the file a row was read from, as it is listed: the column holds it
    percent-encoded, with a plus sign as it is."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def normalize_metrics(rows: DataFrame) -> DataFrame:
    """Common form of raw metrics rows: ``(protein, iteration, r2, mae, rmse, k)``.

    Forest scores win over plain ones. Rows with a blank target and runs whose
    folder stands for no k are dropped; ``iteration`` keeps the ordinal in the
    file.
    """

    def number(name: str) -> Column:
        return null_if_nan(F.col(name).try_cast("double"))

    k = k_from_run_dir(F.col("run_dir"))
    return rows.select(
        strip(F.col("target")).alias("protein"),
        F.col("iteration").cast("long").alias("iteration"),
        F.coalesce(number("rf_r2"), number("r2")).alias("r2"),
        F.coalesce(number("rf_mae"), number("mae")).alias("mae"),
        number("rmse").alias("rmse"),
        k.alias("k"),
    ).filter((F.col("protein") != "") & F.col("k").isNotNull())


def _read(spark: SparkSession, roots: Sequence[str], names: str, pattern: str, **options) -> DataFrame:
    """``(path, _start, value)`` of the files below folders whose path fits ``pattern``."""
    read = spark.read.options(recursiveFileLookup=True, pathGlobFilter=names, **options)
    return read.text(list(roots)).select(
        _read_path().alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value"
    ).filter(F.col("path").rlike(pattern))


def _csv_rows(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Raw rows of CSV files, whatever their columns: each line is cut into fields, and a
    field is taken at the place its name has in the header of the file.

    The header is the first line that isn't blank; blank lines don't count, and files
    without a ``target`` column have no rows. Only the number of fields of the widest
    header reaches the driver.
    """
    read = _read(spark, roots, CSV_NAMES, METRICS_CSV).filter(F.trim("value") != "")
    # Written, so that all readers see the same line numbers.
    lines = materialize(
        read.withColumn("_line", F.monotonically_increasing_id()), "metrics-lines"
    )
    headers = (
        lines.filter(F.col("_start") == 0)
        .groupBy("path")
        .agg(F.min_by("value", "_line").alias("header"), F.min("_line").alias("_header_line"))
    )
    fields = F.length("header") - F.length(F.replace("header", F.lit(","))) + 1
    width = headers.agg(F.max(fields)).first()[0] or 1
    schema = ", ".join(f"_c{i} string" for i in range(width))

    def cut(line: str) -> Column:
        # A line may have more fields than any header.
        return F.from_csv(F.col(line), F.lit(schema), {"escape": '"', "maxColumns": "1000000"})

    def listed(cells: str) -> Column:
        return F.array(*[F.col(f"{cells}._c{i}") for i in range(width)])

    names = headers.withColumn("_cut", cut("header")).withColumn("_names", listed("_cut"))
    place = {name: F.array_position("_names", name).cast("int") for name in ("target", *RAW_FIELDS)}
    places = names.select(
        "path", "_header_line", *[at.alias(f"_at_{name}") for name, at in place.items()]
    ).filter(F.col("_at_target") > 0)

    def field(name: str) -> Column:
        if name == "rmse":
            return F.lit(None).cast("string")
        at = F.col(f"_at_{name}")
        return F.when(at > 0, F.get("_cells", at - 1))

    rows = (
        lines.join(places, "path")
        .filter(F.col("_line") != F.col("_header_line"))
        .withColumn("_cut", cut("value"))
        .withColumn("_cells", listed("_cut"))
        .select(
            "path", "_start", "_line", *[field(name).alias(name) for name in ("target", *RAW_FIELDS)]
        )
    )
    # The ordinal counts every row of the file, blank targets included.
    numbered = sliced_position(rows, ["path"], "_start", ["_line"], "iteration", "_rows")
    return numbered.select("path", "iteration", "target", *RAW_FIELDS)


def _json_rows(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Raw rows of JSON files: an array, or an object with ``results``.

    A file is one value while it is parsed, so it has to fit a task (2 GB at most); what
    isn't JSON has no rows.
    """
    documents = _read(spark, roots, JSON_NAMES, METRICS_JSON, wholetext=True).select(
        "path", F.try_parse_json("value").alias("_doc")
    )
    results = F.try_variant_get("_doc", "$.results", "array<variant>")
    top = F.try_variant_get("_doc", "$", "array<variant>")
    items = documents.select("path", F.posexplode(F.coalesce(results, top)).alias("_at", "_item"))

    def text(name: str) -> Column:
        return F.try_variant_get("_item", f"$.{name}", "string")

    def present(name: str) -> Column:
        # An explicit null counts as present and is not replaced.
        return F.try_variant_get("_item", f"$.{name}", "variant").isNotNull()

    return items.filter(F.schema_of_variant("_item").startswith("OBJECT")).select(
        "path",
        (F.col("_at") + 1).cast("long").alias("iteration"),
        text("target").alias("target"),
        text("rf_r2").alias("rf_r2"),
        F.when(~present("rf_r2"), text("r2")).alias("r2"),
        text("rf_mae").alias("rf_mae"),
        F.when(~present("rf_mae"), text("mae")).alias("mae"),
        text("rmse").alias("rmse"),
    )


def read_metrics(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Normalised metrics of all run folders; fails when there are no metrics files.

    No list of files or headers reaches the driver: files are found by name when folders
    are listed, and lines meet the header of their file in a join.
    """
    files = metrics_files(spark, roots)
    if files.isEmpty():
        raise RuntimeError("no metrics files found")
    there = [root.rstrip("/") for root in roots if _exists(spark, root)]
    rows = _csv_rows(spark, there).unionByName(_json_rows(spark, there))
    key = F.regexp_replace(F.col("path"), _SCHEME, "")
    keyed = rows.withColumn("_key", key).drop("path")
    runs = files.select(key.alias("_key"), "run_dir")
    return normalize_metrics(keyed.join(runs, "_key").drop("_key"))
