"""A session with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "tremor", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
