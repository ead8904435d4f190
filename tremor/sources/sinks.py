"""Sinks: CSV tables, partitioned Parquet, JSON results and the text report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor import store
from tremor.functions.parsing import incident_of


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with header; quotes in values are doubled, as the loader reads them."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_incident_classes(cases: DataFrame, path: str) -> None:
    """One CSV folder for each incident class of the faults."""
    cases.withColumn("incident_type", incident_of(F.col("fault"))).where("incident_type is not null").write.mode("overwrite").partitionBy("incident_type").csv(path, header=True, escape='"')


def write_telemetry(df: DataFrame, path: str) -> None:
    """Parquet partitioned by case, so that a case's window reads only its files."""
    df.write.mode("overwrite").partitionBy("case").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    store.write_text(spark, text, path)


def write_json(spark: SparkSession, value, path: str) -> None:
    store.write_text(spark, json.dumps(value, indent=2, default=str), path)


def generated_files(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    return {p: store.exists(spark, p) for p in paths}
