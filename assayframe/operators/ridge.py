"""Ridge regressions of all fits in the same jobs.

The normal equations of a fit are sums over its rows. Every task sums the rows it reads
in tiles, tiles are summed per fit, and a fit is solved where its tiles meet. Where there
are more features than rows the rows themselves are fewer, and the fit is solved in
their space instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators.design import FIT
from assayframe.operators.forests import _matrix
from assayframe.sources.scratch import materialize

# Fixed values of the baseline.
RIDGE_ALPHA = 1.0

# Features on a side of a tile; sums that a task holds before it hands them on, in bytes.
TILE, HELD = 512, 64 << 20
TILES = "target string, fit int, i int, j int, width int, sums binary"
WEIGHTS = "target string, fit int, coefficients array<double>, intercept double"
_TILES = pa.schema(
    [
        ("target", pa.string()),
        ("fit", pa.int32()),
        ("i", pa.int32()),
        ("j", pa.int32()),
        ("width", pa.int32()),
        ("sums", pa.binary()),
    ]
)
_WEIGHTS = pa.schema(
    [
        ("target", pa.string()),
        ("fit", pa.int32()),
        ("coefficients", pa.list_(pa.float64())),
        ("intercept", pa.float64()),
    ]
)


def _tiles(key: tuple, sums: np.ndarray, side: int) -> Iterator[tuple]:
    """Upper tiles of the sums of products of ``(features, y, 1)``."""
    for i in range(0, len(sums), side):
        for j in range(i, len(sums), side):
            tile = np.ascontiguousarray(sums[i : i + side, j : j + side])
            yield (*key, i // side, j // side, len(sums) - 2, tile.tobytes())


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_TILES)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, _TILES)], schema=_TILES)


def _summed(side: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products per fit over the rows of a partition."""

    def handed_on(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        rows = [row for key, sums in held.items() for row in _tiles(key, sums, side)]
        held.clear()
        return _batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.table(batch)
            fits = table.group_by(["target", "fit"]).aggregate([])
            for target, fit in zip(fits.column("target").to_pylist(), fits.column("fit").to_pylist()):
                own = table.filter((pc.field("target") == target) & (pc.field("fit") == fit))
                x = _matrix(own.column("scaled"))
                whole = np.concatenate([x, own.column("y").to_numpy()[None, :], np.ones((1, own.num_rows))])
                products = whole @ whole.T
                if (target, fit) in held:
                    held[target, fit] += products
                else:
                    held[target, fit] = products
            if sum(sums.nbytes for sums in held.values()) > most_bytes:
                yield handed_on(held)
        if held:
            yield handed_on(held)

    return run


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tile of a fit, however many tasks have a part in it."""
    total, width = None, 0
    for batch in batches:
        width = batch.column("width")[0].as_py()
        for sums in batch.column("sums"):
            part = np.frombuffer(sums.as_buffer(), float)
            total = part.copy() if total is None else total + part
    target, fit, i, j = (value.as_py() for value in key)
    yield _batch_of([(target, fit, i, j, width, total.tobytes())])


def solve(sums: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (not penalised) from the sums of products of
    ``(features, y, 1)``."""
    width, n = len(sums) - 2, sums[-1, -1]
    mean_x, mean_y = sums[:width, -1] / n, sums[-2, -1] / n
    products = sums[:width, :width] - n * np.outer(mean_x, mean_x)
    right = sums[:width, -2] - n * mean_x * mean_y
    coefficients = np.linalg.solve(products + alpha * np.eye(width), right)
    return coefficients, float(mean_y - mean_x @ coefficients)


def solve_in_rows(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """The same from the rows (``x`` with a line per feature)."""
    mean_x, mean_y = x.mean(axis=1), float(y.mean())
    centred = x - mean_x[:, None]
    dual = np.linalg.solve(centred.T @ centred + alpha * np.eye(len(y)), y - mean_y)
    coefficients = centred @ dual
    return coefficients, float(mean_y - mean_x @ coefficients)


def _weights_row(target: str, fit: int, found: tuple[np.ndarray, float]) -> pa.Table:
    return pa.table([[target], [fit], [found[0].tolist()], [found[1]]], schema=_WEIGHTS)


def _solved(alpha: float, side: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        target, fit = (value.as_py() for value in key)
        size = table.column("width")[0].as_py() + 2
        sums = np.zeros((size, size))
        for row in table.to_pylist():
            i, j = row["i"] * side, row["j"] * side
            tile = np.frombuffer(row["sums"], float).reshape(min(side, size - i), min(side, size - j))
            sums[i : i + side, j : j + side] = tile
            sums[j : j + side, i : i + side] = tile.T
        return _weights_row(target, fit, solve(sums, alpha))

    return run


def _solved_in_rows(alpha: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        target, fit = (value.as_py() for value in key)
        x = _matrix(table.column("scaled"))
        return _weights_row(target, fit, solve_in_rows(x, table.column("y").to_numpy(), alpha))

    return run


def fit_ridges(
    design: DataFrame, alpha: float = RIDGE_ALPHA, side: int = TILE, most_bytes: int = HELD
) -> DataFrame:
    """``target, fit, coefficients, intercept`` of a ridge on the standardised features
    of the training rows of every fit in the design.

    A task holds the square of the number of features, or of rows where these are
    fewer. Fits without training rows have none.
    """
    rows = design.where("role = 'train'").select(*FIT, "y", "scaled")
    sizes = materialize(
        rows.groupBy(*FIT).agg((F.count(F.lit(1)) < F.max(F.size("scaled"))).alias("wide")), "ridge-fits"
    )
    marked = rows.join(F.broadcast(sizes), list(FIT))
    tiles = (
        marked.where(~F.col("wide"))
        .drop("wide")
        .mapInArrow(_summed(side, most_bytes), TILES)
        .groupBy(*FIT, "i", "j")
        .applyInArrow(_merged, TILES)
    )
    tall = tiles.groupBy(*FIT).applyInArrow(_solved(alpha, side), WEIGHTS)
    wide = marked.where("wide").groupBy(*FIT).applyInArrow(_solved_in_rows(alpha), WEIGHTS)
    return tall.unionByName(wide)


def predict(weights: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` to rows of a design with ``scaled``."""
    products = F.zip_with("scaled", "coefficients", lambda x, w: x * w)
    value = F.aggregate(products, F.col("intercept"), lambda total, x: total + x)
    # One row per fit.
    return rows.join(weights, list(FIT)).withColumn("prediction", value).drop("coefficients", "intercept")
