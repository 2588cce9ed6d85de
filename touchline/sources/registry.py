"""Model registry: metadata rows in a table, artifacts as saved Spark pipelines and tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.match import ntz
from touchline.operators.models import CalibratedModel, Calibrator, GbtMulticlass, TrainingRun, VectorModel
from touchline.schema import MODEL_VERSION


def version_name(algorithm: str, at: datetime) -> str:
    return f"{algorithm}_{at:%Y%m%d_%H%M%S}"


def model_row(spark: SparkSession, *, id: int, algorithm: str, at: datetime, metrics: dict[str, float],
              hyperparameters: dict, version: str | None = None) -> DataFrame:
    """A new, inactive registry row. The accuracy column is the metric of that exact name, else NULL."""
    row = (id, version or version_name(algorithm, at), algorithm, False, metrics.get("accuracy"),
           {k: float(v) for k, v in metrics.items() if v is not None}, json.dumps(hyperparameters), at)
    return spark.createDataFrame([row], MODEL_VERSION)


def save_model(model: PipelineModel, row: DataFrame, root: str, version: str) -> None:
    """Artifact first, metadata row after it, so a listed version can always be loaded."""
    model.write().overwrite().save(f"{root}/models/{version}")
    row.write.mode("append").parquet(f"{root}/model_versions")


def load_model(root: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{version}")


def save_run(run: TrainingRun, row: DataFrame, root: str, version: str) -> None:
    """Preparation, model, calibrator, metrics and column names of a whole run; the metadata row after them.

    What is loaded scores raw features as the run does. Isotonic steps are saved as the table they are, logistic curves as numbers.
    """
    path, model, calibrator = f"{root}/runs/{version}", run.model.model, run.model.calibrator
    boosted = isinstance(model, GbtMulticlass)
    about = {"boosted": boosted, "columns": run.columns, "method": calibrator and calibrator.method, "curves": None}
    run.prepared.write().overwrite().save(f"{path}/prepared")
    if boosted:
        model.save(f"{path}/model")
    else:
        PipelineModel([model.classifier()]).write().overwrite().save(f"{path}/model")
    if calibrator and calibrator.method == "isotonic":
        calibrator.maps.write.mode("overwrite").parquet(f"{path}/steps")
    elif calibrator:
        about["curves"] = [[cls, float(a), float(b)] for cls, (a, b) in sorted(calibrator.maps.items())]
    run.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    row.sparkSession.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")
    row.write.mode("append").parquet(f"{root}/model_versions")


def load_run(spark: SparkSession, root: str, version: str) -> TrainingRun:
    path = f"{root}/runs/{version}"
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    model = GbtMulticlass.load(f"{path}/model") if about["boosted"] else VectorModel(PipelineModel.load(f"{path}/model"))
    calibrator = None
    if about["method"]:
        curves = about["curves"]
        calibrator = Calibrator(about["method"], spark.read.parquet(f"{path}/steps") if curves is None else {c: (a, b) for c, a, b in curves})
    scorer = CalibratedModel(model, calibrator)
    return TrainingRun(PipelineModel.load(f"{path}/prepared"), scorer, spark.read.parquet(f"{path}/metrics"), about["columns"])


def activate(models: DataFrame, version: str | Column) -> DataFrame:
    """Exactly the named version becomes active. ``previous_version`` tells which one was."""
    was = models.filter("is_active").agg(F.min("version")).scalar()
    return models.withColumn("previous_version", was).withColumn("is_active", F.col("version") == version)


def active_model(models: DataFrame) -> DataFrame:
    return models.filter("is_active")


def delete_model(models: DataFrame, predictions: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Registry and predictions without the version."""
    gone = models.filter(F.col("version") == version).select("id")
    kept = models.join(gone, "id", "left_anti")
    rest = predictions.join(gone.withColumnRenamed("id", "model_version_id"), "model_version_id", "left_anti")
    return kept, rest


def model_list(models: DataFrame, *, algorithm: str | None = None, active_only: bool = False) -> DataFrame:
    """Versions, newest first, with the number of features and the active version."""
    active = models.filter("is_active").agg(F.min("version")).scalar()
    rows = models.withColumn("active_version", active)
    if algorithm:
        rows = rows.filter(F.col("algorithm") == algorithm)
    if active_only:
        rows = rows.filter("is_active")
    names = F.from_json("hyperparameters", "feature_names array<string>")["feature_names"]
    return rows.withColumn("features_count", F.when(names.isNotNull(), F.size(names)).otherwise(0)).orderBy(F.col("created_at").desc(), "id")


def model_detail(models: DataFrame) -> DataFrame:
    """Metrics and hyperparameters default to empty; training size comes from the metrics or is 0."""
    metrics = F.coalesce("metrics", F.from_json(F.lit("{}"), "map<string,double>"))
    return models.select(
        "id", "version", "algorithm", "is_active", "accuracy", metrics.alias("metrics"),
        F.coalesce("hyperparameters", F.lit("{}")).alias("hyperparameters"),
        F.coalesce(F.try_element_at(metrics, F.lit("training_samples")), F.lit(0.0)).cast("long").alias("training_data_size"))


def registry_at(models: DataFrame, created: dict[int, str]) -> DataFrame:
    """Attach creation times by id; used by fixtures."""
    at = F.lit(None).cast("timestamp_ntz")
    for id_, text in created.items():
        at = F.when(F.col("id") == id_, ntz(text)).otherwise(at)
    return models.withColumn("created_at", at)
