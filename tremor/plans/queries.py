"""The query catalogue: each name takes (spark, sf_dir) and returns a frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor import store
from tremor.config import DetectorConfig
from tremor.functions import parsing
from tremor.operators import detect as D
from tremor.operators import correlate, etl, evaluate, incidents, ivf, normalize, profile, similar
from tremor.operators import logs as L
from tremor.schemas import EVENT_COLUMNS, METRICS_META
from tremor.sources import loader, resource_store
from tremor.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WINDOW_MS = (1705000000500, 1705600000500)
ONE_DAY_MS = 86_400_000
GRID_MS, MOST_LAG = ONE_DAY_MS // 4, 6
NAMES = ("checkoutservice_cpu", "ts-auth-service_latency-90", "carts-db_diskio", "a_b_c", "foo", "foo_", "_cpu", " x_cpu ", "x_latency-50", "_", "")


def query(f: Callable[[Tables], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def events(t: Tables) -> DataFrame:
    return normalize.normalize_metrics(t.metrics_long())


def cases(t: Tables) -> DataFrame:
    return evaluate.case_windows(t.ground_truth())


def ends(t: Tables) -> DataFrame:
    return cases(t).select("case_id", F.col("inject_time_ms").alias("baseline_end"))


def found(t: Tables, **options) -> DataFrame:
    return D.detect(events(t), ends(t), DetectorConfig(**options))


def judged(t: Tables) -> DataFrame:
    """What the evaluation looks at: anomalies on the signals of a case's own incident."""
    return D.detect(events(t), ends(t), restrict_to_incident=True)


def traces(t: Tables) -> DataFrame:
    return t.traces_raw().withColumn("timestamp_ms", F.col("startTimeMillis"))


def logs(t: Tables) -> DataFrame:
    return loader.to_ms(t.logs_raw(), "timestamp", "timestamp_ms")


def points(t: Tables) -> DataFrame:
    return D.build_series(events(t)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def metrics(t: Tables, by_points: bool = False) -> DataFrame:
    return evaluate.evaluate_cases(cases(t), judged(t), points(t) if by_points else None)


def names(t: Tables) -> DataFrame:
    literal = t.spark.createDataFrame([(x,) for x in NAMES], "metric_name string")
    return literal.union(t.metrics_long().select("metric_name").distinct())


# Load
@query
def load_metrics_window(t):
    wide = loader.window(loader.case_filter(t.metrics_wide(), "case_1"), "time", *WINDOW_MS)
    return loader.to_ms(wide, "time", "timestamp").select("case", "time", "timestamp", "svc-0_cpu", "svc-1_error")


@query
def load_logs_window(t):
    return loader.to_ms(loader.window(loader.case_filter(t.logs_raw(), "case_2"), "timestamp", 1704067200500, 1704667200500), "timestamp", "timestamp_ms")


@query
def load_traces_window(t):
    return loader.window(loader.case_filter(t.traces_raw(), "case_0"), "startTimeMillis", 1704067205000, 1704367205000, per_second=False).select("case", "traceID", "spanID", "serviceName", "startTimeMillis", "duration")


@query
def list_cases(t):
    return t.ground_truth().select("case").where("case is not null").distinct()


@query
def case_windows(t):
    return cases(t)


@query
def metric_columns(t):
    """The metric columns that hold a value, with how many."""
    wide = t.metrics_wide()
    values = [c for c in wide.columns if c not in METRICS_META]
    counts = wide.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in values])
    return counts.unpivot([], [F.col(f"`{c}`") for c in values], "metric_name", "n")


@query
def case_bundle_counts(t):
    parts = [("metrics", t.metrics_long().select("case", "timestamp")), ("logs", logs(t).select("case", F.col("timestamp_ms").alias("timestamp"))), ("traces", t.traces_raw().select("case", F.col("startTimeMillis").alias("timestamp")))]
    rows = [x.select(F.lit(name).alias("source"), F.col("case").alias("case_id"), "timestamp") for name, x in parts]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).join(cases(t), "case_id")
    inside = F.col("timestamp").between(F.col("time_start_ms"), F.col("time_end_ms"))
    return rows.where(inside).groupBy("case_id", "source").agg(F.count(F.lit(1)).alias("n"))


# Reshape
@query
def unpivot_metrics(t):
    return loader.unpivot(loader.to_ms(t.metrics_wide(), "time", "timestamp")).select("case", "timestamp", "metric_name", "value")


@query
def crosstab_dataset_fault(t):
    return profile.crosstab(t.metrics_long(), "dataset", "fault", ["cpu", "delay", "loss", "socket"])


# Parse
@query
def parse_service(t):
    return names(t).select("metric_name", parsing.service_of(F.col("metric_name")).alias("service"))


@query
def parse_signal(t):
    return names(t).select("metric_name", parsing.signal_of(F.col("metric_name")).alias("signal"))


@query
def parse_fallback(t):
    odd = t.read("events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string"), F.lit("odd")).alias("metric_name")).distinct()
    return odd.select("metric_name", parsing.service_of(F.col("metric_name")).alias("service"), parsing.signal_of(F.col("metric_name")).alias("signal"))


@query
def metric_parseable(t):
    return names(t).select("metric_name", parsing.is_parseable(F.col("metric_name")).alias("parseable"))


# Normalise
@query
def normalize_metrics(t):
    return r6(events(t), "value")


@query
def normalize_logs(t):
    return normalize.normalize_logs(logs(t)).select("event_id", "case_id", "timestamp_ms", "source", "service_name", "message")


@query
def normalize_traces(t):
    return normalize.normalize_traces(traces(t)).select("event_id", "case_id", "timestamp_ms", "source", "service_name", "trace_id", "span_id", "parent_span_id", "method_name", "operation_name", "duration_ms", "status_code")


@query
def normalize_all(t):
    rows = normalize.normalize_all(t.spark, metrics=t.metrics_long(), logs=logs(t), traces=traces(t), ordered=False)
    return r6(rows.select(*[c for c in EVENT_COLUMNS if c not in ("dataset", "fault", "root_cause_service")]), "value")


@query
def events_by_source(t):
    rows = normalize.normalize_all(t.spark, metrics=t.metrics_long(), logs=logs(t), traces=traces(t), ordered=False)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


# Series
@query
def build_series(t):
    return r6(D.build_series(events(t)), "value")


@query
def series_incident_restricted(t):
    return r6(D.build_series(events(t), restrict_to_incident=True), "value").select(*D.KEYS, "timestamp_ms", "value")


@query
def series_bounds(t):
    return r6(D.build_series(events(t)).groupBy(*D.KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.min("value").alias("low"), F.max("value").alias("high")), "low", "high")


@query
def series_arrays(t):
    rows = D.series_arrays(D.build_series(events(t)))
    return rows.select(*D.KEYS, F.array_join(F.col("timestamps").cast("array<string>"), ",").alias("timestamps"), F.size("values").cast("bigint").alias("n"))


# Baseline
@query
def baseline_stats(t):
    rows = D.baselines(D.in_baseline(D.build_series(events(t)), ends(t)), None)
    return r6(rows, "mean", "std", "max").drop("quantile")


@query
def baseline_quantile(t):
    return r6(D.baselines(D.in_baseline(D.build_series(events(t)), ends(t))), "quantile").select(*D.KEYS, "quantile")


@query
def baseline_eligible(t):
    return D.eligible(D.baselines(D.in_baseline(D.build_series(events(t)), ends(t)), None), DetectorConfig()).select(*D.KEYS, "n_total", "n_base")


@query
def baseline_first_half(t):
    return r6(D.baselines(D.in_baseline(D.build_series(events(t)), None), None), "mean", "std", "max").drop("quantile")


# Detect
def _short(df: DataFrame) -> DataFrame:
    return r6(df.select(*D.KEYS, "timestamp_ms", "value", "score", "threshold", "incident_type"), "value", "score", "threshold")


@query
def zscore_anomalies(t):
    return _short(found(t))


@query
def quantile_anomalies(t):
    return _short(found(t, method="threshold"))


@query
def anomalies_min_value(t):
    return _short(found(t, min_value=400.0))


@query
def anomalies_no_baseline_end(t):
    return _short(D.detect(events(t)))


@query
def anomaly_event_ids(t):
    return found(t).select("event_id", "method")


def _edge(t: Tables, pick) -> DataFrame:
    order = F.struct("timestamp_ms", "service", "signal_type", "value")
    return r6(found(t).groupBy("case_id").agg(pick(order).alias("o")).select("case_id", "o.*"), "value")


@query
def first_anomaly(t):
    return _edge(t, F.min)


@query
def last_anomaly(t):
    return _edge(t, F.max)


# Evaluate
@query
def validate_detection(t):
    return evaluate.validate_detection(cases(t), judged(t))


@query
def validate_detection_windowed(t):
    return evaluate.validate_detection(cases(t), judged(t), ONE_DAY_MS)


@query
def detection_summary(t):
    return r6(evaluate.summarize(evaluate.validate_detection(cases(t), judged(t))), "detection_rate", "avg_delay_seconds")


@query
def detection_summary_by_incident(t):
    return r6(evaluate.summarize_by_incident(evaluate.validate_detection(cases(t), judged(t))), "detection_rate")


def _cases(df: DataFrame) -> DataFrame:
    return r6(df.withColumn("detected_services", F.array_join("detected_services", ",")), "recall", "precision", "f1_score")


@query
def case_metrics_binary(t):
    return _cases(metrics(t))


@query
def case_metrics_points(t):
    return _cases(metrics(t, by_points=True))


@query
def aggregate_metrics(t):
    df = evaluate.aggregate(metrics(t, by_points=True))
    return r6(df, *[c for c, kind in df.dtypes if kind == "double"])


@query
def delay_stats(t):
    return r6(evaluate.delay_stats(metrics(t)), "avg_delay_seconds", "median_delay_seconds", "max_delay_seconds")


@query
def per_incident_metrics(t):
    return r6(evaluate.per_incident(metrics(t)), "detection_rate", "avg_delay_seconds", "avg_recall", "avg_precision", "avg_f1")


@query
def per_fault_metrics(t):
    return r6(evaluate.per_fault(metrics(t)), "detection_rate", "avg_delay_seconds")


@query
def root_cause_hits(t):
    return metrics(t).select("case_id", "root_cause_service", "root_cause_detected")


@query
def before_after_counts(t):
    return evaluate.before_after(cases(t), D.detect(events(t)))


@query
def scenario_check(t):
    return evaluate.scenario_check(cases(t), found(t)).withColumn("incident_types", F.array_join("incident_types", ","))


@query
def scenario_acceptance(t):
    return evaluate.group_acceptance(evaluate.scenario_check(cases(t), found(t)))


@query
def case_quality(t):
    return evaluate.case_quality(cases(t))


@query
def anomalies_in_time_order(t):
    rows = D.detect_in_events(events(t), ends(t))
    return r6(rows.select(*D.KEYS, "timestamp_ms", "value", "score"), "value", "score")


# Dataset build
@query
def incident_class_split(t):
    parts = [etl.incident_class(t.ground_truth(), i).select(F.lit(i).alias("incident_type"), "case", "fault") for i in ("cpu_saturation", "db_latency", "network_failure")]
    return etl.union_rows(*parts)


@query
def ground_truth_semi(t):
    return etl.semi(t.ground_truth(), t.logs_raw().where("container_name = 'user'")).select("case", "dataset", "fault")


@query
def telemetry_with_case(t):
    rows = t.traces_raw().select("case", "spanID", "serviceName", "duration")
    return etl.with_case(rows, t.ground_truth())


@query
def cases_without_telemetry(t):
    return etl.without_telemetry(t.ground_truth(), t.logs_raw()).select("case", "fault")


@query
def union_heterogeneous(t):
    return etl.union_rows(t.logs_raw().select("case", "container_name", "timestamp"), t.traces_raw().select("case", "serviceName", "time"))


@query
def services(t):
    return etl.services(t.traces_raw())


@query
def dependencies(t):
    return etl.dependencies(t.traces_raw())


# Profile
@query
def value_counts_dataset(t):
    return profile.value_counts(t.metrics_long(), "dataset")


@query
def value_counts_fault(t):
    return profile.value_counts(t.traces_raw(), "fault")


@query
def value_counts_root_cause(t):
    return profile.value_counts(t.logs_raw(), "root_cause_service")


@query
def value_counts_ordered(t):
    """The fault counts in the three orders."""
    counts = profile.value_counts(t.traces_raw(), "fault")
    orders = {"key": ("fault",), "desc": (F.desc("n"), "fault"), "asc": ("n", "fault")}
    parts = [counts.select(F.lit(name).alias("ordered_by"), (F.row_number().over(Window.orderBy(*by)) - 1).alias("place"), "fault", "n") for name, by in orders.items()]  # a row for each fault
    return etl.union_rows(*parts)


@query
def first_cases(t):
    return t.ground_truth().select("case").where("case is not null").distinct().orderBy("case").limit(10)


@query
def duplicate_rows(t):
    return profile.duplicate_rows(t.traces_raw().select("case", "traceID", "spanID", "serviceName"))


@query
def null_counts(t):
    return profile.null_counts(t.metrics_wide())


@query
def column_profile(t):
    return profile.column_profile(t.traces_raw().select("case", "spanID", "serviceName", "parentSpanID", "duration")).drop("dtype")


@query
def top_root_causes(t):
    return profile.top(t.metrics_long(), "metric_name", 5)


@query
def system_name_counts(t):
    return t.metrics_long().select(parsing.system_of(F.col("dataset")).alias("system_name")).groupBy("system_name").agg(F.count(F.lit(1)).alias("n"))


@query
def inject_time_datetime(t):
    at = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, try_cast(inject_time as bigint))"  # whatever the session's time zone
    return t.ground_truth().select("case", F.expr(f"date_format({at}, 'yyyy-MM-dd HH:mm:ss')").alias("injected_at"))


@query
def topology_counts(t):
    return etl.dependencies(t.traces_raw()).groupBy("source").agg(F.count(F.lit(1)).alias("n_targets"))


# Beyond the batch pipeline
@query
def reachable_services(t):
    return etl.reachable(etl.dependencies(t.traces_raw()))


@query
def first_deviation(t):
    return etl.first_deviation(found(t))


@query
def similar_vectors(t):
    v = t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return r6(similar.similar(v, v.where("id % 50 = 0"), 5), "similarity")


@query
def logs_near_incident(t):
    return etl.logs_near(normalize.normalize_logs(logs(t)), cases(t), 15 * ONE_DAY_MS, ONE_DAY_MS).select("event_id", "case_id", "timestamp_ms", "service_name")


@query
def incident_nodes(t):
    return r6(etl.incident_nodes(found(t)), "peak_score")


def burst_signals(t: Tables) -> DataFrame:
    """Written once: a few rows, made from all events and read several times."""
    return store.park(incidents.session_signals(found(t), ONE_DAY_MS), "bursts")


def burst_members(t: Tables, signals: DataFrame) -> DataFrame:
    return incidents.members(incidents.sessions(signals), etl.dependencies(t.traces_raw()))


@query
def anomaly_sessions(t):
    return r6(incidents.sessions(burst_signals(t)), "peak")


@query
def incident_sessions(t):
    rows = incidents.incident_sessions(burst_members(t, burst_signals(t)))
    return r6(rows.withColumn("services", F.array_join("services", ",")), "peak_score")


@query
def impact_paths(t):
    """From the root cause of each case."""
    origins = cases(t).select("case_id", F.col("root_cause_service").alias("service"))
    return incidents.impact_paths(incidents.sessions(burst_signals(t)), etl.dependencies(t.traces_raw()), origins, ONE_DAY_MS)


@query
def similar_incidents(t):
    """Of each case's main incident."""
    signals = burst_signals(t)
    prints = store.park(incidents.fingerprints(burst_members(t, signals), signals).withColumnRenamed("incident_id", "id"), "fingerprints")
    wanted = incidents.main_incidents(prints.withColumnRenamed("id", "incident_id")).withColumnRenamed("incident_id", "id")
    return r6(ivf.search(ivf.build(prints, cells=16), wanted, 3), "similarity")


@query
def similar_vectors_indexed(t):
    v = t.read("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return r6(ivf.search(ivf.build(v, cells=64), v.where("cast(id as bigint) % 50 = 0"), 5), "similarity")


@query
def relevant_logs(t):
    """Around the middle of each case's own logs, whose clock in these tables is not that of the cases."""
    rows = logs(t).withColumnRenamed("case", "case_id")
    return r6(L.relevant_logs(rows, L.own_pivots(rows)), "score")


@query
def lead_lag(t):
    """Against the series of each case that deviates first."""
    first = etl.first_deviation(found(t)).where("place = 1")
    return r6(correlate.lead_lag(D.build_series(events(t)), first, GRID_MS, MOST_LAG), "corr")


@query
def stored_points(t):
    """Points of the resource store after one load and a second one of a single case, by resource and day."""
    path = f"{store.shared_dir(t.spark)}/resources-{uuid.uuid4().hex}"
    rows = resource_store.points(events(t))
    resource_store.upsert(rows, path)
    resource_store.upsert(rows.where("case_id = 'case_1'"), path)
    found = resource_store.read(t.spark, path)
    return r6(found.groupBy("resource", "day").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high")), "high")


@query
def detection_report(t):
    """Rows only: the lines of the text report."""
    from tremor.operators import report

    config = DetectorConfig()
    text = report.format_report(report.results(evaluate.run_evaluation(events(t), t.ground_truth(), config, points(t)), config))
    return t.spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@query
def detection_results_json(t):
    """Rows only: a JSON object for each case."""
    return evaluate.run_evaluation(events(t), t.ground_truth())["cases"].select("case_id", F.to_json(F.struct("*")).alias("json"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: z-score anomalies of all cases."""
    return QUERIES["zscore_anomalies"](spark, sf_dir)
