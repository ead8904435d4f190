"""Series, baselines and anomalies, for all cases at once.

Frames keep one row per point.  The only shuffle is the aggregation by
(case_id, service, signal); a broadcast of its result, one row per series and
checked by the optimizer's size limit, joins it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.config import DETECTABLE_SIGNALS, INCIDENT_SIGNALS, DetectorConfig
from tremor.functions.parsing import finite, float_text, incident_of, z_score
from tremor.operators.quantile import quantiles

KEYS = ("case_id", "service", "signal_type")


def restricted(incident: Column, signal: Column) -> Column:
    """Whether the signal belongs to the incident; an unknown incident restricts nothing."""
    out = F.lit(True)
    for name, signals in INCIDENT_SIGNALS.items():
        out = F.when(incident == name, signal.isin(*signals)).otherwise(out)
    return F.coalesce(out, F.lit(True))


def build_series(events: DataFrame, restrict_to_incident: bool = False) -> DataFrame:
    """Finite points of detectable signals of metric events."""
    rows = events.where(F.col("source") == "metric").select(
        "case_id", F.coalesce(F.nullif("service_name", F.lit("")), F.lit("unknown")).alias("service"), "signal_type", "timestamp_ms", finite(F.col("value")).alias("value"),
        "fault", "root_cause_service", incident_of(F.col("fault")).alias("incident_type"),
    )
    rows = rows.where(F.col("value").isNotNull() & F.col("signal_type").isin(*DETECTABLE_SIGNALS))
    return rows.where(restricted(F.col("incident_type"), F.col("signal_type"))) if restrict_to_incident else rows


def series_arrays(series: DataFrame) -> DataFrame:
    """Series objects: points in time order.  Only where the arrays are the output."""
    points = F.array_sort(F.collect_list(F.struct("timestamp_ms", "value")))
    return series.groupBy(*KEYS).agg(points.alias("points")).select(*KEYS, F.col("points.timestamp_ms").alias("timestamps"), F.col("points.value").alias("values"))


def in_baseline(series: DataFrame, baseline_end: DataFrame | None) -> DataFrame:
    """Adds in_baseline and evaluated.  ``baseline_end``: case_id and baseline_end
    in ms; without it the first half of each series is the baseline, and every
    point is evaluated."""
    if baseline_end is None:
        by = Window.partitionBy(*KEYS)
        place = F.row_number().over(by.orderBy("timestamp_ms", "value"))
        return series.withColumn("in_baseline", place <= F.floor(F.count(F.lit(1)).over(by) / 2)).withColumn("evaluated", F.lit(True))
    rows = series.join(baseline_end.select("case_id", "baseline_end"), "case_id")
    return rows.withColumn("in_baseline", F.col("timestamp_ms") < F.col("baseline_end")).withColumn("evaluated", ~F.col("in_baseline")).drop("baseline_end")


def baselines(points: DataFrame, quantile: float | None = 0.95) -> DataFrame:
    """Per series: n_total, n_base, mean, population std, max and the linearly interpolated quantile.

    The quantile is exact and found in fixed memory a series, by histograms
    that are refined over the points; None leaves it null and has one pass."""
    base = F.when(F.col("in_baseline"), F.col("value"))
    stats = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_total"), F.count(base).alias("n_base"), F.avg(base).alias("mean"), F.stddev_pop(base).alias("std"), F.max(base).alias("max"))
    if quantile is None:
        return stats.withColumn("quantile", F.lit(None).cast("double"))
    known = points.where("in_baseline").select(F.struct(*KEYS).alias("series"), "value")
    found = quantiles(known, ["series"], "value", quantile)
    return stats.withColumn("series", F.struct(*KEYS)).join(found, "series", "left").drop("series")


def eligible(stats: DataFrame, config: DetectorConfig) -> DataFrame:
    return stats.where((F.col("n_total") >= config.min_baseline_samples) & (F.col("n_base") >= config.min_baseline_samples))


def detect(events: DataFrame, baseline_end: DataFrame | None = None, config: DetectorConfig | None = None, restrict_to_incident: bool = False) -> DataFrame:
    """Anomalies: event_id, keys, timestamp_ms, value, method, score, threshold, incident_type and the baseline's figures."""
    config = config or DetectorConfig()
    points = in_baseline(build_series(events, restrict_to_incident), baseline_end)
    stats = eligible(baselines(points, config.threshold_quantile if config.method == "threshold" else None), config)
    rows = points.where("evaluated")
    if config.min_value is not None:
        rows = rows.where(F.col("value") >= config.min_value)
    rows = rows.join(stats, list(KEYS))
    if config.method == "z_score":
        rows = rows.withColumn("score", z_score(F.col("value"), F.col("mean"), F.col("std"))).withColumn("threshold", F.lit(float(config.z_threshold)))
        rows = rows.where(F.abs("score") >= config.z_threshold)
    else:
        rows = rows.where(F.col("value") > F.col("quantile")).withColumn("score", F.col("value")).withColumn("threshold", F.col("quantile"))
    event_id = F.concat_ws("|", *KEYS, float_text(F.col("timestamp_ms")), F.lit(config.method))
    return rows.select(
        event_id.alias("event_id"), *KEYS, "timestamp_ms", "value", F.lit(config.method).alias("method"), "score", "threshold", "incident_type", "fault", "root_cause_service",
        F.struct("mean", "std", "max", "quantile", F.col("n_base").alias("samples")).alias("baseline"),
    )


def detect_in_events(events: DataFrame, baseline_end: DataFrame | None = None, config: DetectorConfig | None = None, restrict_to_incident: bool = True) -> DataFrame:
    """The anomalies of events, by time; ties by series."""
    return detect(events, baseline_end, config, restrict_to_incident).orderBy("timestamp_ms", *KEYS)
