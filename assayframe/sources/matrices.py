"""Foreign matrices, wide or long, to cells and back."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import header_levels, null_if_nan
from assayframe.operators.align import oriented

# Accepted names of the columns of a long table, first match
# wins, and the labels of value blocks in a header.
SAMPLE_NAMES = ("sample", "sample_id", "patient_id")
FEATURE_NAMES = ("gene", "protein", "feature", "id")
VALUE_NAMES = ("value", "expression", "abundance", "intensity")
VALUE_BLOCKS = ("raw", "z", "meta")

CELLS_PER_BATCH = 65_536
CELLS_PER_TASK = 16_000_000
COLUMNS_PER_TASK = 4_096


def long_columns(columns: Sequence[str]) -> dict[str, str] | None:
    """Columns that hold sample, feature and value, or None for a wide table."""
    lowered: dict[str, str] = {}
    for name in columns:
        lowered.setdefault(name.lower(), name)
    roles = {"sample_id": SAMPLE_NAMES, "feature": FEATURE_NAMES, "value": VALUE_NAMES}
    found = {
        role: next((lowered[alias] for alias in aliases if alias in lowered), None)
        for role, aliases in roles.items()
    }
    return found if all(found.values()) else None


def read_long(frame: DataFrame) -> DataFrame:
    """``(sample_id, feature, value)`` of a long table; duplicates averaged."""
    roles = long_columns(frame.columns)
    if roles is None:
        raise ValueError(f"no sample, feature and value columns among {frame.columns}")
    named = frame.select(
        F.col(f"`{roles['sample_id']}`").cast("string").alias("sample_id"),
        F.col(f"`{roles['feature']}`").cast("string").alias("feature"),
        null_if_nan(F.col(f"`{roles['value']}`")).alias("value"),
    )
    keyed = named.filter(F.col("sample_id").isNotNull() & F.col("feature").isNotNull())
    return keyed.groupBy("sample_id", "feature").agg(F.avg("value").alias("value"))


def numeric_columns(frame: DataFrame) -> list[str]:
    """Numeric columns; all of them if there are none."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    numeric = [name for name, kind in frame.dtypes if kind.startswith(kinds)]
    return numeric or list(frame.columns)


def unpivot_matrix(
    frame: DataFrame, sample: str, label: str = "feature", values: Sequence[str] | None = None
) -> DataFrame:
    """Wide to long within one row, missing cells left out. For up to some ten
    thousand columns; wider files go through :func:`read_wide`."""
    columns = [
        name
        for name in (values or numeric_columns(frame.drop(sample)))
        if name != sample
    ]
    doubles = frame.select(
        F.col(f"`{sample}`").cast("string").alias("sample_id"),
        *[null_if_nan(F.col(f"`{name}`")).alias(name) for name in columns],
    )
    quoted = [F.col(f"`{name}`") for name in columns]
    return doubles.unpivot("sample_id", quoted, label, "value").filter(
        F.col("value").isNotNull()
    )


def load_matrix(frame: DataFrame, index: str | None = None) -> DataFrame:
    """``(sample_id, feature, value)`` of a long or wide table in either
    orientation.

    A long table is known by its column names. A wide one needs ``index``, the
    column with the row labels; its other numeric columns are the other axis.
    """
    if long_columns(frame.columns) is not None:
        return read_long(frame)
    if index is None:
        raise ValueError("a wide table needs the column of its row labels")
    columns = [name for name in numeric_columns(frame.drop(index)) if name != index]
    places = F.create_map(
        *[part for i, name in enumerate(columns) for part in (F.lit(name), F.lit(i))]
    )
    numbered = frame.select(
        F.col(f"`{index}`").cast("string").alias("row"),
        F.monotonically_increasing_id().alias("row_ord"),
        *[null_if_nan(F.col(f"`{name}`")).alias(name) for name in columns],
    )
    quoted = [F.col(f"`{name}`") for name in columns]
    # Missing cells still count for the shape of the matrix.
    cells = numbered.unpivot(["row", "row_ord"], quoted, "column", "value").withColumn(
        "column_ord", places[F.col("column")]
    )
    return oriented(cells, row_axis=index).filter(F.col("value").isNotNull())


def pivot_mean(
    cells: DataFrame, rows: str, columns: str, labels: Sequence, value: str = "value"
) -> DataFrame:
    """Long to wide with the mean of duplicates. The labels are given, so no
    extra job looks for them; modelling stays long and never needs this."""
    return cells.groupBy(rows).pivot(columns, list(labels)).agg(F.avg(value))


def with_header(cells: DataFrame, label: str = "label") -> DataFrame:
    """Split a column label into feature key columns.

    Two levels are name and id, three are name, transcript and id, or value
    block, name and id. Any other depth fails.
    """
    levels = header_levels(F.col(label))
    depth = F.size("_levels")
    block = (depth == 3) & F.col("_levels")[0].isin(*VALUE_BLOCKS)

    def level(index: int) -> Column:
        return F.get("_levels", F.lit(index))

    wrong = F.raise_error(F.concat(F.lit("unsupported header: "), F.col(label)))
    return (
        cells.withColumn("_levels", levels)
        .withColumns(
            {
                "value_type": F.when(block, level(0)),
                "feature_name": F.when(block, level(1))
                .when((depth == 2) | (depth == 3), level(0))
                .otherwise(wrong.cast("string")),
                "transcript_id": F.when((depth == 3) & ~block, level(1)),
                "database_id": F.when(depth == 3, level(2)).otherwise(level(1)),
            }
        )
        .drop("_levels", label)
    )


# ---- very wide files ----------------------------------------------------------
#
# Hundreds of thousands of columns make neither a usable Spark schema nor a
# usable unpivot. Such files are read by many tasks instead: one per file, row
# group and range of columns, each reading only its part and emitting cells.


def _open(path: str):
    """Open a listed path, which is not percent-encoded."""
    from urllib.parse import quote

    import pyarrow.fs
    import pyarrow.parquet

    scheme, colon, rest = path.partition(":")
    if not colon or path.startswith("/"):
        filesystem, inner = pyarrow.fs.LocalFileSystem(), path
    elif scheme == "file":
        filesystem, inner = pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        # Spark's name of a store and that of its own client.
        store = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        filesystem, inner = pyarrow.fs.FileSystem.from_uri(f"{store}:{quote(rest, safe='/:@')}")
    return pyarrow.parquet.ParquetFile(filesystem.open_input_file(inner))


def _index_column(schema, given: str | None) -> str:
    if given:
        return given
    described = json.loads((schema.metadata or {}).get(b"pandas", b"{}"))
    names = [name for name in described.get("index_columns", []) if isinstance(name, str)]
    if not names:
        raise ValueError("no sample index recorded in the file; name the column")
    return names[0]


def _measured(schema, index: str) -> list[str]:
    import pyarrow.types as kinds

    def numeric(kind) -> bool:
        return kinds.is_floating(kind) or kinds.is_integer(kind) or kinds.is_decimal(kind)

    return [field.name for field in schema if field.name != index and numeric(field.type)]


def _plan_ranges(index: str | None, width: int):
    def plan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    schema = file.schema_arrow
                    measured = _measured(schema, _index_column(schema, index))
                    first_row = 0
                    parts = []
                    for group in range(file.num_row_groups):
                        rows = file.metadata.row_group(group).num_rows
                        step = max(1, min(width, CELLS_PER_TASK // max(1, rows)))
                        for start in range(0, len(measured), step):
                            parts.append((path, group, first_row, start, start + step))
                        first_row += rows
                names = ["path", "row_group", "first_row", "start", "stop"]
                columns = list(zip(*parts)) if parts else [[]] * len(names)
                kinds = [pa.string()] + [pa.int64()] * 4
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return plan


def _read_ranges(index: str | None, cohort: str | None):
    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in batch.to_pylist():
                with _open(part["path"]) as file:
                    schema = file.schema_arrow
                    key = _index_column(schema, index)
                    labels = _measured(schema, key)[part["start"] : part["stop"]]
                    tagged = cohort is not None and cohort in schema.names
                    wanted = [key, *([cohort] if tagged else []), *labels]
                    table = file.read_row_group(part["row_group"], columns=wanted)
                samples = np.array(
                    [None if s is None else str(s) for s in table.column(key).to_pylist()],
                    dtype=object,
                )
                rows = np.arange(len(samples), dtype=np.int64) + part["first_row"]
                cohorts = np.full(len(samples), None, dtype=object)
                if tagged:
                    cohorts[:] = table.column(cohort).to_pylist()
                step = max(1, CELLS_PER_BATCH // max(1, len(samples)))
                for start in range(0, len(labels), step):
                    chunk = labels[start : start + step]
                    values = np.concatenate(
                        [
                            table.column(name).to_numpy().astype(np.float64, copy=False)
                            for name in chunk
                        ]
                    )
                    seen = ~np.isnan(values)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part["path"]] * int(seen.sum()), pa.string()),
                            pa.array(np.tile(cohorts, len(chunk))[seen], pa.string()),
                            pa.array(np.tile(samples, len(chunk))[seen], pa.string()),
                            pa.array(np.tile(rows, len(chunk))[seen], pa.int64()),
                            pa.array(
                                np.repeat(np.array(chunk, dtype=object), len(samples))[seen],
                                pa.string(),
                            ),
                            pa.array(values[seen], pa.float64()),
                        ],
                        ["path", "cohort", "sample_id", "occ", "label", "value"],
                    )

    return read


def read_wide(
    spark: SparkSession,
    paths: DataFrame,
    index: str | None = None,
    cohort: str | None = None,
    columns_per_task: int = COLUMNS_PER_TASK,
    tasks: int | None = None,
) -> DataFrame:
    """Cells of very wide parquet files: ``(path, cohort, sample_id, occ, label,
    value)`` with ``occ`` the row number in the file.

    ``paths`` is a frame with a ``path`` column, such as
    :func:`~assayframe.sources.cells.cohort_tables`. ``index`` names the sample
    column unless the file records it, ``cohort`` the column that holds the
    cohort, if any. Footers are read by tasks as well.
    """
    count = tasks or spark.sparkContext.defaultParallelism * 4
    # A given number of partitions is kept as is: the rows are tiny, and would
    # otherwise be merged into one task.
    ranges = (
        paths.select("path")
        .repartition(count)
        .mapInArrow(
            _plan_ranges(index, columns_per_task),
            "path string, row_group long, first_row long, start long, stop long",
        )
    )
    return ranges.repartition(count).mapInArrow(
        _read_ranges(index, cohort),
        "path string, cohort string, sample_id string, occ long, label string, value double",
    )


def _read_index(index: str | None):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    key = _index_column(file.schema_arrow, index)
                    row = 0
                    for group in file.iter_batches(columns=[key]):
                        samples = [None if s is None else str(s) for s in group[0].to_pylist()]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([path] * len(samples), pa.string()),
                                pa.array(samples, pa.string()),
                                pa.array(range(row, row + len(samples)), pa.int64()),
                            ],
                            ["path", "sample_id", "occ"],
                        )
                        row += len(samples)

    return read


def wide_samples(paths: DataFrame, index: str | None = None, tasks: int | None = None) -> DataFrame:
    """Sample dimension of wide files, samples without any value included."""
    count = tasks or paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(count).mapInArrow(
        _read_index(index), "path string, sample_id string, occ long"
    )


def _read_labels(index: str | None):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    schema = file.schema_arrow
                    labels = _measured(schema, _index_column(schema, index))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(labels), pa.string()), pa.array(labels, pa.string())],
                    ["path", "label"],
                )

    return read


def wide_features(paths: DataFrame, index: str | None = None, tasks: int | None = None) -> DataFrame:
    """Feature dimension of wide files, features without any value included."""
    count = tasks or paths.sparkSession.sparkContext.defaultParallelism
    return paths.select("path").repartition(count).mapInArrow(
        _read_labels(index), "path string, label string"
    )
