"""Saved models with an index table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

INDEX_SCHEMA = "model string, feature_type string, is_best boolean, path string"


def save_models(
    spark: SparkSession,
    models: dict[tuple[str, str], PipelineModel],
    best: tuple[str, str] | None,
    folder: str,
) -> DataFrame:
    """Save every (model, feature set); the best one's folder ends in ``_BEST``."""
    rows = []
    for (name, features), model in models.items():
        is_best = (name, features) == best
        path = f"{folder.rstrip('/')}/{name}__{features}{'_BEST' if is_best else ''}"
        stage = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
        stage.write().overwrite().save(path)
        rows.append((name, features, is_best, path))
    index = spark.createDataFrame(rows, INDEX_SCHEMA)
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/index")
    return index


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/index")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_best(spark: SparkSession, folder: str) -> PipelineModel:
    row = list_models(spark, folder).where(F.col("is_best")).first()
    if row is None:
        raise ValueError(f"no best model recorded in {folder}")
    return load_model(row["path"])
