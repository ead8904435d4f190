"""Time series of resources on disk: a folder for each resource and day, rows in order inside, upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.store import exists, park

LAYOUT = ("resource", "day")
KEY = ("case_id", "metric_name", "timestamp_ms")
SCHEMA = "case_id string, timestamp_ms bigint, signal_type string, metric_name string, value double, resource string, day string"
DAY_MS = 86_400_000


def _day(ms: Column) -> Column:
    """The day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int")).cast("string")


def points(events: DataFrame) -> DataFrame:
    """Rows of the store from canonical metric events; a null or empty service is the resource ``unknown``.  Points
    without a time can't be placed and are left out."""
    rows = events.where("source = 'metric' and timestamp_ms is not null")
    resource = F.coalesce(F.nullif("service_name", F.lit("")), F.lit("unknown"))
    return rows.select("case_id", "timestamp_ms", "signal_type", "metric_name", "value", resource.alias("resource"), _day(F.col("timestamp_ms")).alias("day"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def upsert(rows: DataFrame, path: str) -> None:
    """Add ``rows`` (as from ``points``) to the store; a row replaces the one of equal case, metric and time.

    Of equal keys in ``rows`` the largest value stays.  Only the folders that
    the rows fall in are read and written again, the others keep their files;
    doing it twice changes nothing.  What is read is written elsewhere first,
    so that a job that dies leaves either the old or the new folder.  A folder
    of very many rows is split over tasks and files, each in order.
    """
    spark = rows.sparkSession
    new = rows.groupBy(*KEY, *LAYOUT).agg(F.max(F.struct("value", "signal_type")).alias("x"))
    new = park(new.select("case_id", "timestamp_ms", "x.signal_type", "metric_name", "x.value", *LAYOUT), "upsert")
    whole = new
    if exists(spark, path):
        touched = _stored(spark, path).join(new.select(*LAYOUT).distinct(), list(LAYOUT), "left_semi")
        same = [touched[c].eqNullSafe(new[c]) for c in KEY] + [touched[c] == new[c] for c in LAYOUT]
        kept = touched.join(new, on=[*same], how="left_anti")
        whole = park(kept.select(*new.columns).unionByName(new), "upsert")
    dealt = whole.hint("rebalance", *LAYOUT).sortWithinPartitions(*LAYOUT, "metric_name", "timestamp_ms", "case_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def read(spark: SparkSession, path: str, resource: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Stored points of a resource and a span of time (inclusive).  Both are conditions on folders, so that others are
    not even listed, and the time is one on the sorted files too."""
    rows = _stored(spark, path)
    if resource is not None:
        rows = rows.where(F.col("resource") == resource)
    for bound, keep in ((start_ms, Column.__ge__), (end_ms, Column.__le__)):
        if bound is not None:
            day = spark.range(1).select(_day(F.lit(bound))).first()[0]
            rows = rows.where(keep(F.col("timestamp_ms"), bound) & keep(F.col("day"), day))
    return rows
