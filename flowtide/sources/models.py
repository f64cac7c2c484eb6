"""Model directories: pipeline, fitted feature values, registry record."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowtide.operators.prep import FeatureStats
from flowtide.plans.training import TrainedModel


def save_model(model: TrainedModel, path: str, record: DataFrame | None = None) -> None:
    spark = SparkSession.active()
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.stats.to_df(spark).coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    spark.createDataFrame([(list(model.classes), list(model.stats.names), model.version, model.model_type)],
                          "classes array<string>, features array<string>, version string, model_type string"
                          ).coalesce(1).write.mode("overwrite").json(f"{path}/config")
    if record is not None:
        record.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    config = spark.read.json(f"{path}/config").first()
    stats = FeatureStats.from_df(
        spark.read.schema("feature string, median double, mean double, std double").json(f"{path}/stats"), list(config.features))
    return TrainedModel(PipelineModel.load(f"{path}/pipeline"), stats, tuple(config.classes), config.version, config.model_type)
