"""Save and load fitted models and their result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.train import FittedModel, TrainingRun


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def save_models(spark: SparkSession, models: Mapping[str, FittedModel], path: str) -> None:
    """One folder per model plus a catalogue of names and features."""
    for m in models.values():
        m.pipeline.write().overwrite().save(f"{path}/models/{_slug(m.name)}")
    entries = F.array(*[
        F.struct(F.lit(m.name).alias("name"), F.array(*[F.lit(c) for c in m.features]).alias("features"))
        for m in models.values()
    ])
    spark.range(1).select(F.inline(entries)).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalogue")


def load_models(spark: SparkSession, path: str) -> dict[str, FittedModel]:
    return {
        r["name"]: FittedModel(
            r["name"], tuple(r["features"]), PipelineModel.load(f"{path}/models/{_slug(r['name'])}")
        )
        for r in spark.read.parquet(f"{path}/catalogue").collect()  # one row per model
    }


def save_run(run: TrainingRun, path: str) -> None:
    save_models(run.frame.sparkSession, run.models, path)
    for name, table in run.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tables/{name}")
