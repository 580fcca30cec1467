"""Random draws of forest parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.operators.ranking import seeded_digest, top_per_group
from assayframe.operators.split import SEED

# Fixed values of the search.
GRID = {
    "model__n_estimators": [300, 500, 800, 1200],
    "model__max_depth": [None, 5, 10, 20, 40],
    "model__min_samples_split": [2, 5, 10, 20],
    "model__min_samples_leaf": [1, 2, 4, 8],
    "model__max_features": ["sqrt", "log2", 0.2, 0.5, 0.8],
    "model__bootstrap": [True, False],
}
DRAWS = 30


def parameter_draws(
    spark: SparkSession,
    n_iter: int = DRAWS,
    seed: int = SEED,
    grid: Mapping[str, Sequence] = GRID,
) -> DataFrame:
    """``(draw, params)``: ``n_iter`` distinct combinations in seeded order, each
    as JSON text. Combinations are numbered; digits of the number in mixed radix
    pick the values, so the grid is never joined."""
    pieces, stride = [], 1
    for name, values in grid.items():
        options = F.array(*[F.lit(json.dumps(value)) for value in values])
        digit = F.floor(F.col("id") / stride) % len(values)
        pieces.append(F.concat(F.lit(json.dumps(name) + ": "), F.get(options, digit.cast("int"))))
        stride *= len(values)
    params = F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))
    combinations = spark.range(prod(len(values) for values in grid.values()))
    drawn = top_per_group(combinations, [], [seeded_digest(F.col("id"), seed), "id"], n_iter, "draw")
    return drawn.select("draw", params.alias("params"))


def search_plan(targets: DataFrame, draws: DataFrame) -> DataFrame:
    """Every target with every draw. The draws are as many as were asked for,
    and travel as a literal."""
    listed = draws.orderBy("draw").collect()
    options = F.array(
        *[F.struct(F.lit(row.draw).alias("draw"), F.lit(row.params).alias("params")) for row in listed]
    )
    return targets.select("target", F.inline(options))
