"""Fixed schemas, and the check for required columns."""

from __future__ import annotations

from dataclasses import make_dataclass

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = (
    "event_id string, case_id string, timestamp_ms bigint, dataset string, fault string, root_cause_service string, source string, service_name string, "
    "signal_type string, metric_name string, value double, message string, trace_id string, span_id string, parent_span_id string, method_name string, "
    "operation_name string, duration_ms double, status_code double"
)
EVENT_COLUMNS = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
#: One canonical event: its fields are the columns, in their order; all but the first three and source may be None.
Event = make_dataclass("Event", EVENT_COLUMNS, frozen=True, slots=True)
CASE = ("case", "dataset", "fault", "root_cause_service")
METRICS_META = (*CASE, "time")
LOG_SCHEMA = "case string, dataset string, fault string, root_cause_service string, timestamp bigint, container_name string, message string"
TRACE_SCHEMA = (
    "case string, dataset string, fault string, root_cause_service string, time bigint, traceID string, spanID string, serviceName string, methodName string, "
    "operationName string, parentSpanID string, startTimeMillis bigint, startTime bigint, duration double, statusCode double"
)
GROUND_TRUTH_SCHEMA = (
    "case string, dataset string, suite string, system_name string, fault string, fault_description string, root_cause_service string, inject_time bigint, "
    "time_start bigint, time_end bigint, duration_minutes double, normal_timesteps bigint, faulty_timesteps bigint"
)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def require(df: DataFrame, columns, source: str) -> DataFrame:
    """``df`` itself; ValueError with the sorted missing columns otherwise."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{source}: missing columns {missing}")
    return df


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)
