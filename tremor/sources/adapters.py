"""Telemetry views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE = ("svc-0_cpu", "svc-1_cpu", "svc-0_error", "svc-1_error", "svc-0_latency-90", "svc-1_latency-90")


class Tables:
    """The views of one data folder, each a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ground_truth(self) -> DataFrame:
        base = "1705320000 + i * 3600"
        return self.read("region").where("r_regionkey < 4").selectExpr("cast(r_regionkey as bigint) as i").selectExpr(
            "concat('case_', i) as case", "concat('DS-', case i when 0 then 'OB' when 1 then 'SS' when 2 then 'TT' else 'OB' end) as dataset",
            "case i when 0 then 'cpu' when 1 then 'delay' when 2 then 'loss' else 'socket' end as fault", "concat('svc-', i % 2) as root_cause_service",
            f"cast({base} as bigint) as inject_time", f"cast({base} - 1209600 as bigint) as time_start", f"cast({base} + 1209600 as bigint) as time_end",
        )

    def _cases(self) -> DataFrame:
        return F.broadcast(self.ground_truth().select("case", "dataset", "fault", "root_cause_service"))  # four rows

    def metrics_long(self) -> DataFrame:
        seconds = F.expr("cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1000000) as bigint)")  # whatever the session's time zone
        signal = F.expr("case event_type when 'click' then 'cpu' when 'view' then 'workload' when 'purchase' then 'latency-90' when 'error' then 'error' else 'socket' end")
        e = self.read("events").select(F.expr("concat('case_', user_id % 4)").alias("case"), F.expr("concat('svc-', cast(floor(user_id / 4) as bigint) % 2)").alias("service"), signal.alias("signal"), seconds.alias("time"), "value")
        e = e.join(self._cases(), "case")
        return e.select("case", "dataset", "fault", "root_cause_service", "time", (F.col("time") * 1000).alias("timestamp"), F.concat_ws("_", "service", "signal").alias("metric_name"), "value")

    def metrics_wide(self) -> DataFrame:
        keys = ("case", "dataset", "fault", "root_cause_service", "time")
        return self.metrics_long().groupBy(*keys).agg(*[F.max(F.when(F.col("metric_name") == c, F.col("value"))).alias(c) for c in WIDE])

    def logs_raw(self) -> DataFrame:
        c = self.read("conversations").selectExpr("concat('case_', conv_id % 4) as case", "cast(1704067200 + conv_id * 600 + turn as bigint) as timestamp", "role as container_name", "text as message")
        return c.join(self._cases(), "case").select("case", "dataset", "fault", "root_cause_service", "timestamp", "container_name", "message")

    def traces_raw(self) -> DataFrame:
        second = "cast(1704067200 + (l_orderkey % 43200) * 60 + l_linenumber as bigint)"
        t = self.read("lineitem").selectExpr(
            "concat('case_', l_orderkey % 4) as case", f"{second} as time", "string(l_orderkey) as traceID", "concat(l_orderkey, '-', l_linenumber) as spanID",
            "concat('svc-', l_suppkey % 7) as serviceName", "l_linestatus as methodName", "l_returnflag as operationName",
            "case when l_linenumber > 1 then concat(l_orderkey, '-', l_linenumber - 1) end as parentSpanID", f"{second} * 1000 as startTimeMillis", f"{second} * 1000000 as startTime",
            "l_quantity as duration", "case when l_returnflag = 'R' then 1.0D else 0.0D end as statusCode",
        )
        t = t.join(self._cases(), "case")
        return t.select("case", "dataset", "fault", "root_cause_service", "time", "traceID", "spanID", "serviceName", "methodName", "operationName", "parentSpanID", "startTimeMillis", "startTime", "duration", "statusCode")
