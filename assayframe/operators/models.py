"""Fitted models as Spark ML pipelines: median filling and selection, then a regressor.

Rows have ``target, sample_id, y`` and their observed cells as ``cells``, a map from
feature to value. A pipeline fits the models of all targets together, keeps them as
tables, and can be saved and loaded as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsReadable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators import forests, ridge
from assayframe.operators.design import FIT, FULL_FIT
from assayframe.operators.joins import checked_broadcast
from assayframe.operators.selection import feature_statistics, rank_features
from assayframe.operators.split import SEED
from assayframe.sources.scratch import materialize


def sample_rows(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows for a pipeline from ``target, sample_id`` (and ``y``) and the observed cells
    ``target, sample_id, feature, x``."""
    packed = cells.groupBy("target", "sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("cells")
    )
    return labels.join(packed, ["target", "sample_id"], "left")


class _FrameWriter(MLWriter):
    def __init__(self, instance: "_FrameModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.frame.write.parquet(f"{path}/data")


class _FrameReader(MLReader):
    def __init__(self, kind: type["_FrameModel"]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "_FrameModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/data"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _FrameModel(Model, MLWritable, MLReadable):
    """A model that is a table."""

    def __init__(self, frame: DataFrame):
        super().__init__()
        self.frame = frame

    def write(self) -> MLWriter:
        return _FrameWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FrameReader(cls)


class MedianSelectionModel(_FrameModel):
    """Fills missing cells with their median and lays the selected features out in the
    order of their rank, as they are (``features``) and standardised (``scaled``).

    The table has ``target, feature, rank, median, mean, scale``.
    """

    def _transform(self, rows: DataFrame) -> DataFrame:
        each = F.struct("rank", "feature", "median", "mean", "scale")
        columns = self.frame.groupBy("target").agg(F.sort_array(F.collect_list(each)).alias("_columns"))
        cells = F.coalesce("cells", F.create_map().cast("map<string,double>"))
        value = F.transform(
            "_columns", lambda c: F.coalesce(F.try_element_at(cells, c["feature"]), c["median"])
        )
        scaled = F.zip_with("features", "_columns", lambda x, c: (x - c["mean"]) / c["scale"])
        return (
            rows.join(checked_broadcast(columns), "target")
            .withColumn("features", value)
            .withColumn("scaled", scaled)
            .drop("_columns")
        )


class MedianSelection(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """Medians and the ``k`` best features of each target by their F score; below two
    every feature."""

    k: Param[int] = Param(Params._dummy(), "k", "features to keep", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k: int = 0):
        super().__init__()
        self._setDefault(k=0)
        self._set(k=k)

    def _fit(self, rows: DataFrame) -> MedianSelectionModel:
        labels = rows.select("target", "y")
        observed = rows.select("target", "y", F.explode("cells").alias("feature", "x"))
        statistics = feature_statistics(observed.where(F.col("x").isNotNull()), labels)
        ranked = rank_features(statistics, self.getOrDefault(self.k))
        kept = ranked.select("target", "feature", "rank", "median", "mean", "scale")
        return MedianSelectionModel(materialize(kept, "selected"))


def _as_design(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fit": F.lit(FULL_FIT), "role": F.lit("train")})


class ForestRegressionModel(_FrameModel):
    """Mean of the trees of a target. The table has a row per node."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        return forests.apply(self.frame, rows)


class ForestRegression(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """A forest per target; ``params`` are those of a draw of the search, as JSON."""

    params_: Param[str] = Param(Params._dummy(), "params_", "parameters as JSON", TypeConverters.toString)
    seed: Param[int] = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, params_: str = "{}", seed: int = SEED):
        super().__init__()
        self._setDefault(params_="{}", seed=SEED)
        self._set(params_=params_, seed=seed)

    def _fit(self, rows: DataFrame) -> ForestRegressionModel:
        chosen = rows.select("target").distinct().select(
            "target",
            F.lit(1).cast("long").alias("draw"),
            F.lit(self.getOrDefault(self.params_)).alias("params"),
        )
        nodes, _ = forests.fit(_as_design(rows), chosen, self.getOrDefault(self.seed))
        return ForestRegressionModel(nodes)


class RidgeRegressionModel(_FrameModel):
    """Linear model of the standardised features. The table has a row per target."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        return ridge.predict(self.frame, rows.withColumn("fit", F.lit(FULL_FIT))).drop("fit")


class RidgeRegression(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """A ridge per target, intercept not penalised."""

    alpha: Param[float] = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha: float = ridge.RIDGE_ALPHA):
        super().__init__()
        self._setDefault(alpha=ridge.RIDGE_ALPHA)
        self._set(alpha=alpha)

    def _fit(self, rows: DataFrame) -> RidgeRegressionModel:
        weights = ridge.fit_ridges(_as_design(rows), self.getOrDefault(self.alpha))
        return RidgeRegressionModel(materialize(weights, "ridge"))


def forest_pipeline(k: int, params: Mapping, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[MedianSelection(k=k), ForestRegression(params_=json.dumps(dict(params)), seed=seed)])


def ridge_pipeline(k: int, alpha: float = ridge.RIDGE_ALPHA) -> Pipeline:
    return Pipeline(stages=[MedianSelection(k=k), RidgeRegression(alpha=alpha)])


def fitted(selected: DataFrame, regressor: _FrameModel) -> PipelineModel:
    """The pipeline of a run from its selected features (of the full fit)."""
    columns = selected.where(F.col("fit") == FULL_FIT).select(
        "target", "feature", "rank", "median", "mean", "scale"
    )
    return PipelineModel([MedianSelectionModel(columns), regressor])


def weights_of(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("fit") == FULL_FIT).select(*FIT, "coefficients", "intercept")
