"""Tracked runs: parameters, metrics of every repetition, tags and tables, each run in a folder of its own.

A run's manifest is written last, so a run is whole or it isn't there: readers look for manifests alone.
Where MLflow is installed and asked for, the same parameters, summaries and tags go there too.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.files import read_artifacts, read_manifest, write_artifacts

METRICS = "repetition int, metric string, value double"


def summarised(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) over repetitions; the deviation is that of the population."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def log_run(spark: SparkSession, folder: str, params: Mapping[str, Any], repetitions: Sequence[Mapping[str, float]], tables: Mapping[str, DataFrame] | None = None, tags: Mapping[str, str] | None = None, run: str | None = None, mlflow_uri: str | None = None) -> str:
    """Write a run below the folder and give back its name. `metrics` is a table's name of its own."""
    if "metrics" in (tables or {}):
        raise ValueError("a run's table can't be called metrics")
    run = run or uuid.uuid4().hex
    rows = [(n, name, float(value)) for n, metrics in enumerate(repetitions) for name, value in sorted(metrics.items())]
    metrics = spark.createDataFrame(rows, METRICS)
    write_artifacts(f"{folder}/{run}", {"metrics": metrics, **(tables or {})}, {"params": dict(params), "tags": dict(tags or {})}, spark)
    if mlflow_uri is not None:
        _log_mlflow(mlflow_uri, run, params, summarised(metrics), tags or {})
    return run


def _log_mlflow(uri: str, run: str, params: Mapping[str, Any], summary: DataFrame, tags: Mapping[str, str]) -> None:
    import mlflow

    mlflow.set_tracking_uri(uri)
    with mlflow.start_run(run_name=run):
        mlflow.set_tags(dict(tags))
        mlflow.log_params(dict(params))
        for r in summary.collect():  # a row for each metric
            for stat in ("mean", "std", "min", "max"):
                mlflow.log_metric(f"{r['metric']}_{stat}", r[stat])


def read_run(spark: SparkSession, folder: str, run: str) -> tuple[dict, DataFrame, dict[str, DataFrame]]:
    """(params and tags, metrics, tables) of a whole run; one without a manifest is an error of Spark's reader."""
    manifest = read_manifest(f"{folder}/{run}", spark)
    tables = read_artifacts(f"{folder}/{run}", list(manifest["tables"]), spark)
    return manifest["notes"], tables.pop("metrics"), tables


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, params, tags) of all whole runs in the folder, the maps as JSON."""
    path = F.split(F.col("_metadata.file_path"), "/")
    found = spark.read.text(f"{folder}/*/manifest").select(F.element_at(path, -3).alias("run"), "value")
    return found.select("run", F.get_json_object("value", "$.notes.params").alias("params"), F.get_json_object("value", "$.notes.tags").alias("tags"))


def as_repetitions(rows: DataFrame, names: Sequence[str], order: str) -> list[dict[str, float]]:
    """Metrics of each repetition, of which there are few."""
    return [{n: float(r[n]) for n in names} for r in rows.orderBy(order).collect()]

