"""Run history and saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthaste import schemas
from posthaste.sources.tables import path_exists


def save_metadata(spark: SparkSession, path: str, run: dict) -> None:
    """Add one run to a JSON table, so runs can be compared by a query."""
    row = {f.name: run.get(f.name) for f in schemas.RUN_HISTORY.fields}
    (spark.createDataFrame([row], schemas.RUN_HISTORY)
     .withColumn("saved_at", F.coalesce("saved_at", F.current_timestamp()))
     .coalesce(1).write.mode("append").json(path))


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.RUN_HISTORY)
    return spark.read.schema(schemas.RUN_HISTORY).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
