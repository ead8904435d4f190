"""Anomalies against ground truth: verdicts, metrics and summaries.

Times are in ms; delay_seconds = ms / 1000.  Joins start from ground truth,
so that cases without an anomaly stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions.parsing import incident_of, seconds_to_ms


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def case_windows(ground_truth: DataFrame) -> DataFrame:
    """case_id, fault, root cause, incident type and times in ms."""
    ms = [seconds_to_ms(F.col(c)).alias(f"{c}_ms") for c in ("inject_time", "time_start", "time_end")]
    return ground_truth.select(F.col("case").alias("case_id"), "dataset", "fault", "root_cause_service", incident_of(F.col("fault")).alias("incident_type"), *ms)


def _hits(cases: DataFrame, anomalies: DataFrame) -> DataFrame:
    own = anomalies.select("case_id", "timestamp_ms", "service", "method", F.lit(1).alias("hit"))
    return cases.join(own, "case_id", "left")


def validate_detection(cases: DataFrame, anomalies: DataFrame, window_ms: int | None = None) -> DataFrame:
    ok = F.col("timestamp_ms") >= F.col("inject_time_ms")
    if window_ms is not None:
        ok = ok & (F.col("timestamp_ms") <= F.col("inject_time_ms") + window_ms)
    rows = _hits(cases, anomalies).groupBy("case_id", "fault", "incident_type", "root_cause_service", "inject_time_ms").agg(
        F.count_if(ok).alias("valid_anomalies"), F.count("hit").alias("total_anomalies"), F.min(F.when(ok, F.col("timestamp_ms"))).alias("first_detection_ms"),
        F.min_by("method", F.when(ok, F.col("timestamp_ms"))).alias("detection_method"),
    )
    delay = (F.col("first_detection_ms") - F.col("inject_time_ms")) / 1000.0
    return rows.select("case_id", "fault", "incident_type", "root_cause_service", (F.col("valid_anomalies") > 0).alias("detected"), "first_detection_ms", delay.alias("delay_seconds"), "valid_anomalies", "total_anomalies", F.when(F.col("valid_anomalies") > 0, F.col("detection_method")).alias("detection_method"))


def summarize(results: DataFrame) -> DataFrame:
    """One row for all cases."""
    return results.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("detected").alias("detected_cases"), F.coalesce(F.avg(F.col("detected").cast("int")), F.lit(0.0)).alias("detection_rate"), F.avg(F.when(F.col("detected"), F.col("delay_seconds"))).alias("avg_delay_seconds"))


def summarize_by_incident(results: DataFrame) -> DataFrame:
    rate = F.avg(F.col("detected").cast("int"))
    return results.groupBy(F.coalesce("incident_type", F.lit("unknown")).alias("incident_type")).agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"), rate.alias("detection_rate"))


def evaluate_cases(cases: DataFrame, anomalies: DataFrame, total_points: DataFrame | None = None) -> DataFrame:
    """Metrics of each case.  ``total_points``: case_id and n; where it gives a
    positive n, recall is by points, else 1 for a detected case."""
    ts, inject = F.col("timestamp_ms"), F.col("inject_time_ms")
    tp, fp = (ts >= inject) & (ts <= F.col("time_end_ms")), (ts >= F.col("time_start_ms")) & (ts < inject)
    keys = ("case_id", "fault", "incident_type", "root_cause_service", "inject_time_ms", "time_start_ms", "time_end_ms")
    rows = _hits(cases, anomalies).groupBy(*keys).agg(
        F.count_if(tp).alias("true_positives"), F.count_if(fp).alias("false_positives"), F.count("hit").alias("anomaly_count"), F.min(F.when(tp, ts)).alias("first_detection_ms"),
        F.min_by("method", F.when(tp, ts)).alias("method"), F.array_sort(F.collect_set(F.nullif("service", F.lit("")))).alias("detected_services"),
    )
    rows = rows.join(total_points.select("case_id", "n"), "case_id", "left") if total_points is not None else rows.withColumn("n", F.lit(None).cast("bigint"))
    faulty = F.greatest(F.lit(0), F.col("time_end_ms") - inject)
    normal = F.greatest(F.lit(0), inject - F.col("time_start_ms"))
    whole = F.col("time_end_ms") - F.col("time_start_ms")
    detected, by_points = F.col("true_positives") > 0, F.coalesce(F.col("n") > 0, F.lit(False))

    def points(part: Column) -> Column:
        share = F.greatest(F.lit(1), F.floor(F.col("n") * (part / F.nullif(whole, F.lit(0)))).cast("bigint"))
        return F.when(by_points, F.when(whole > 0, share).otherwise(0)).otherwise(part).cast("bigint")

    rows = rows.withColumns({"total_faulty_points": points(faulty), "total_normal_points": points(normal), "precision": ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))})
    rows = rows.withColumn("recall", F.when(by_points, ratio(F.col("true_positives"), F.col("total_faulty_points"))).otherwise(detected.cast("double")))
    return rows.select(
        "case_id", "fault", "incident_type", "root_cause_service", detected.alias("detected"), ((F.col("first_detection_ms") - inject) / 1000.0).alias("delay_seconds"), "true_positives", "false_positives",
        "total_faulty_points", "total_normal_points", "recall", "precision", harmonic(F.col("precision"), F.col("recall")).alias("f1_score"), "detected_services",
        F.coalesce(F.array_contains("detected_services", F.col("root_cause_service")), F.lit(False)).alias("root_cause_detected"), "first_detection_ms",
        F.when(detected, F.col("method")).alias("detection_method"), "anomaly_count",
    )


def aggregate(metrics: DataFrame) -> DataFrame:
    """One row of global metrics; zeros and null delays without cases."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    delay = F.when(F.col("detected"), F.col("delay_seconds"))
    rows = metrics.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("detected").alias("detected_cases"), mean(F.col("detected").cast("int")).alias("detection_rate"),
        mean("recall").alias("avg_recall"), mean("precision").alias("avg_precision"), mean("f1_score").alias("avg_f1_score"),
        zero(F.sum("true_positives")).alias("total_true_positives"), zero(F.sum("false_positives")).alias("total_false_positives"), zero(F.sum("total_faulty_points")).alias("faulty"),
        F.avg(delay).alias("avg_delay_seconds"), F.median(delay).alias("median_delay_seconds"), F.max(delay).alias("max_delay_seconds"), mean(F.col("root_cause_detected").cast("int")).alias("root_cause_detection_rate"),
    )
    tp, fp = F.col("total_true_positives"), F.col("total_false_positives")
    rows = rows.withColumn("global_precision", ratio(tp, tp + fp)).withColumn("global_recall", ratio(tp, F.col("faulty")))
    return rows.withColumn("global_f1_score", harmonic(F.col("global_precision"), F.col("global_recall"))).drop("faulty")


def delay_stats(metrics: DataFrame) -> DataFrame:
    return aggregate(metrics).select("avg_delay_seconds", "median_delay_seconds", "max_delay_seconds")


def _by(metrics: DataFrame, key: Column, *more: Column) -> DataFrame:
    return metrics.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"), F.sum("false_positives").alias("false_positives"), F.avg(F.col("detected").cast("int")).alias("detection_rate"),
        F.avg(F.when(F.col("detected"), F.col("delay_seconds"))).alias("avg_delay_seconds"), *more,
    )


def per_incident(metrics: DataFrame) -> DataFrame:
    return _by(metrics, F.coalesce("incident_type", F.lit("unknown")).alias("incident_type"), F.avg("recall").alias("avg_recall"), F.avg("precision").alias("avg_precision"), F.avg("f1_score").alias("avg_f1"))


def per_fault(metrics: DataFrame) -> DataFrame:
    return _by(metrics, F.col("fault"))


def before_after(cases: DataFrame, anomalies: DataFrame) -> DataFrame:
    ts, inject = F.col("timestamp_ms"), F.col("inject_time_ms")
    return _hits(cases, anomalies).groupBy("case_id").agg(F.count_if(ts < inject).alias("before"), F.count_if(ts >= inject).alias("after"))


def scenario_check(cases: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per case the anomalies before and after the injection, and the sorted incident types seen after it; a case
    passes with anomalies after only, among them one of its own type."""
    ts, inject = F.col("timestamp_ms"), F.col("inject_time_ms")
    own = anomalies.select("case_id", "timestamp_ms", F.col("incident_type").alias("seen"))
    rows = cases.join(own, "case_id", "left").groupBy("case_id", "incident_type").agg(
        F.count_if(ts >= inject).alias("after"), F.count_if(ts < inject).alias("before"), F.array_sort(F.collect_set(F.when(ts >= inject, F.col("seen")))).alias("incident_types")
    )
    ok = (F.col("after") > 0) & (F.col("before") == 0) & F.coalesce(F.array_contains("incident_types", F.col("incident_type")), F.lit(False))
    return rows.withColumn("passed", ok)


def group_acceptance(checked: DataFrame) -> DataFrame:
    """One row: a group of scenarios is accepted if each case has anomalies after its injection and none has one before."""
    rows = checked.agg(F.count(F.lit(1)).alias("cases"), F.min("after").alias("min_after"), F.max("before").alias("max_before"))
    return rows.withColumn("accepted", F.coalesce((F.col("min_after") > 0) & (F.col("max_before") == 0), F.lit(False)))


def case_quality(cases: DataFrame) -> DataFrame:
    """case_id and flaw: why a case can't be evaluated, null if it can.  A flawed case is left out, the others go on."""
    times = [F.col(c) for c in ("inject_time_ms", "time_start_ms", "time_end_ms")]
    flaw = F.when(times[0].isNull() | times[1].isNull() | times[2].isNull(), "a time is missing or no number").when((times[1] > times[0]) | (times[0] > times[2]), "the injection is outside of the case's window")
    return cases.select("case_id", flaw.alias("flaw"))


def run_evaluation(events: DataFrame, ground_truth: DataFrame, config=None, total_points: DataFrame | None = None) -> dict[str, DataFrame]:
    """anomalies, cases, aggregate, per_incident, per_fault and skipped (flawed cases) as lazy frames.

    Only the signals of a case's own incident count: a burst on another one detects nothing."""
    from tremor.operators.detect import detect

    known = case_windows(ground_truth).where("case_id is not null")
    flaws = case_quality(known).where("flaw is not null")
    cases = known.join(flaws, "case_id", "left_anti")
    anomalies = detect(events, cases.select("case_id", F.col("inject_time_ms").alias("baseline_end")), config, restrict_to_incident=True)
    metrics = evaluate_cases(cases, anomalies, total_points)
    return {"anomalies": anomalies, "cases": metrics, "aggregate": aggregate(metrics), "per_incident": per_incident(metrics), "per_fault": per_fault(metrics), "skipped": flaws}
