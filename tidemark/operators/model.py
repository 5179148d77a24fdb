"""Gradient-boosted transition model: assemble, fit, predict, rank importances, save."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fit(train: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 6) -> PipelineModel:
    """Trees of the published shape; positives weigh as much in all as negatives.

    Rates of row and column sampling, step and seed follow the published settings; the split
    regularisers have no equal here.
    """
    sums = train.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    weight = sums["n0"] / sums["n1"] if sums["n1"] else 1.0
    weighted = train.withColumn("_w", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0))
    trees = GBTClassifier(labelCol=label, featuresCol="_f", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_f"), trees]).fit(weighted)


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.1) -> DataFrame:
    """df with probability and prediction (probability at or above threshold)."""
    scored = model.transform(df.withColumn("_w", F.lit(1.0))).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*df.columns, F.col("p").alias("probability"), (F.col("p") >= threshold).cast("int").alias("prediction"))


def importances(spark: SparkSession, model: PipelineModel, features: list[str], top: int = 15) -> DataFrame:
    """(rank, feature, importance) of the most important features."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, v) for f, v in zip(features, values, strict=True)], "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")  # a row per feature
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("rank", "feature", "importance")


def save(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_version(model: PipelineModel, features: list[str], root: str) -> str:
    """The model and its ordered feature names in a new folder under root, named by the time; returns its path.

    Earlier versions stay. The names are one text file beside the model, written through Spark, so any store will do.
    """
    spark = SparkSession.getActiveSession()
    path = f"{root}/transition_classifier_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    save(model, f"{path}/model")
    spark.createDataFrame([("\n".join(features),)], "value string").coalesce(1).write.text(f"{path}/features")
    return path


def load_version(path: str) -> tuple[PipelineModel, list[str]]:
    """(model, feature names) of a folder that save_version() made."""
    spark = SparkSession.getActiveSession()
    names = spark.read.text(f"{path}/features", wholetext=True).first()["value"]
    return load(f"{path}/model"), names.strip("\n").split("\n")
