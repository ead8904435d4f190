"""Metrics, logs and traces to the canonical event schema."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor import schemas
from tremor.functions.parsing import service_of, signal_of

METRIC_COLUMNS = (*schemas.CASE, "timestamp", "metric_name", "value")
LOG_COLUMNS = (*schemas.CASE, "timestamp_ms", "container_name", "message")
TRACE_COLUMNS = (*schemas.CASE, "timestamp_ms", "traceID", "spanID", "serviceName", "methodName", "operationName", "parentSpanID", "duration", "statusCode")


def _event(df: DataFrame, source: str, **own: Column) -> DataFrame:
    """One projection to the canonical columns; what is not given is a typed null."""
    given = {"case_id": F.col("case"), "source": F.lit(source), **{c: F.col(c) for c in ("dataset", "fault", "root_cause_service")}, **own}
    kinds = dict(x.split() for x in schemas.EVENT_SCHEMA.split(", "))
    doubles = ("value", "duration_ms", "status_code")
    return df.select(*[(given[c].try_cast("double") if c in given and c in doubles else given.get(c, F.lit(None)).cast(kinds[c])).alias(c) for c in schemas.EVENT_COLUMNS])


def _with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Adds _row_id, the place of the row in its case, from 0, by a total order of its values.

    Rows are numbered within the minutes of a case, each in its own group, and
    the rows of earlier minutes, one count for each, come on top: no task
    holds all rows of a case.
    """
    minute = F.coalesce(F.floor(F.col("timestamp_ms") / 60_000), F.lit(-(1 << 62)))  # no time comes first, as it sorts
    df = df.withColumns({"_case": F.coalesce("case", F.lit("")), "_minute": minute})
    counts = df.groupBy("_case", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_case").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_case", "_minute", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_case", "_minute").orderBy(*order))
    rows = df.join(offsets, ["_case", "_minute"]).withColumn("_row_id", F.col("_before") + place - 1)
    return rows.drop("_case", "_minute", "_before")


def normalize_metrics(df: DataFrame) -> DataFrame:
    schemas.require(df, METRIC_COLUMNS, "metrics")
    ms, name = F.col("timestamp").cast("bigint"), F.col("metric_name")
    event_id = F.concat(F.lit("metric:"), F.col("case"), F.lit(":"), ms.cast("string"), F.lit(":"), name)
    return _event(df, "metric", event_id=event_id, timestamp_ms=ms, service_name=service_of(name), signal_type=signal_of(name), metric_name=name, value=F.col("value"))


def normalize_logs(df: DataFrame) -> DataFrame:
    schemas.require(df, LOG_COLUMNS, "logs")
    ms = F.col("timestamp_ms").cast("bigint")
    df = _with_row_id(df, "timestamp_ms", "container_name", "message")
    event_id = F.concat(F.lit("log:"), F.col("case"), F.lit(":"), ms.cast("string"), F.lit(":"), F.col("_row_id").cast("string"))
    return _event(df, "log", event_id=event_id, timestamp_ms=ms, service_name=F.col("container_name"), message=F.col("message"))


def normalize_traces(df: DataFrame) -> DataFrame:
    schemas.require(df, TRACE_COLUMNS, "traces")
    order = ("timestamp_ms", "spanID", "traceID", "serviceName", "methodName", "operationName", "parentSpanID", "duration", "statusCode")
    df = _with_row_id(df, *order)
    event_id = F.concat(F.lit("trace:"), F.col("case"), F.lit(":"), F.coalesce("spanID", F.lit("unknown")), F.lit(":"), F.col("_row_id").cast("string"))
    return _event(
        df, "trace", event_id=event_id, timestamp_ms=F.col("timestamp_ms").cast("bigint"), service_name=F.col("serviceName"), trace_id=F.col("traceID"), span_id=F.col("spanID"),
        parent_span_id=F.col("parentSpanID"), method_name=F.col("methodName"), operation_name=F.col("operationName"), duration_ms=F.col("duration"), status_code=F.col("statusCode"),
    )


def normalize_all(spark: SparkSession, *, metrics: DataFrame | None = None, logs: DataFrame | None = None, traces: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Events of all sources given, by time and source; an empty frame for none."""
    parts = [f(x) for f, x in ((normalize_metrics, metrics), (normalize_logs, logs), (normalize_traces, traces)) if x is not None]
    if not parts:
        return schemas.empty_events(spark)
    events = reduce(DataFrame.unionByName, parts)
    return events.orderBy("timestamp_ms", "source", "event_id") if ordered else events


def normalize_case(loader, case_id: str, **include: bool) -> DataFrame:
    """Canonical events of one case within its time window."""
    found = loader.load_case(case_id, **include)
    return normalize_all(loader.spark, metrics=found["metrics"], logs=found["logs"], traces=found["traces"])


def to_events(df: DataFrame) -> Iterator[schemas.Event]:
    """The rows of a canonical frame as objects, a partition at a time; for the application's edge only."""
    schemas.require(df, schemas.EVENT_COLUMNS, "events")
    for row in df.select(*schemas.EVENT_COLUMNS).toLocalIterator():
        yield schemas.Event(*row)
