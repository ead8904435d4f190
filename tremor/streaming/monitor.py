"""Anomalies of an event stream: against a static baseline, or of replayed data whose baseline is learnt on the way."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tremor.config import DetectorConfig
from tremor.functions.parsing import z_score
from tremor.operators.detect import KEYS, build_series, eligible


def detect_stream(events: DataFrame, stats: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """Z-score anomalies of a stream of canonical events; ``stats`` as from
    ``detect.baselines``.  A stream-static join, without state."""
    config = config or DetectorConfig()
    rows = build_series(events).join(eligible(stats, config), list(KEYS))
    rows = rows.withColumn("score", z_score(F.col("value"), F.col("mean"), F.col("std"))).where(F.abs("score") >= config.z_threshold)
    return rows.select(*KEYS, "timestamp_ms", "value", "score")


def anomaly_counts(anomalies: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Anomalies of each series by tumbling window, with a watermark for late events."""
    timed = anomalies.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), *KEYS).agg(F.count(F.lit(1)).alias("anomalies")).select(F.col("window.start").alias("start"), *KEYS, "anomalies")


#: What ``replay`` needs of the session: state that its processor can hold.
REPLAY_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_REPLAYED = "case_id string, service string, signal_type string, timestamp_ms bigint, value double, score double"


class _Replay(StatefulProcessor):
    """One series: running moments of its baseline until the watermark passes the injection, points after it wait for that."""

    def __init__(self, z_threshold: float, least: int, idle_ms: int):
        self.z, self.least, self.idle_ms = z_threshold, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "n bigint, mean double, m2 double, ends bigint, frozen boolean, last bigint")
        self.waiting = handle.getListState("waiting", "timestamp_ms bigint, value double")

    def _anomalies(self, key, n: int, mean: float, m2: float, points):
        import numpy as np
        import pandas as pd

        rows = pd.DataFrame(points, columns=["timestamp_ms", "value"]).astype({"timestamp_ms": "int64", "value": "float64"})
        std = (m2 / n) ** 0.5 if n else 0.0
        rows["score"] = (rows.value - mean) / std if std > 0 else 0.0
        rows = rows[(np.abs(rows.score) >= self.z) & (n >= self.least)]
        for name, value in zip(("case_id", "service", "signal_type"), key, strict=True):
            rows[name] = value
        return rows[["case_id", "service", "signal_type", "timestamp_ms", "value", "score"]]

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        n, mean, m2, ends, frozen, last = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, None, False, None)
        later = []
        for frame in rows:
            if not len(frame):
                continue
            ends = int(frame.baseline_end.iloc[0])
            last = max(int(frame.timestamp_ms.max()), last if last is not None else int(frame.timestamp_ms.max()))
            own = frame[frame.timestamp_ms < ends].value.to_numpy()
            if len(own) and not frozen:  # moments of two groups of values make those of both
                shift, total = own.mean() - mean, n + len(own)
                m2 += ((own - own.mean()) ** 2).sum() + shift**2 * n * len(own) / total
                mean, n = mean + shift * len(own) / total, total
            later += [(int(t), float(v)) for t, v in zip(frame.timestamp_ms, frame.value, strict=True) if t >= ends]
        if ends is None:
            return
        if frozen:
            yield self._anomalies(key, n, mean, m2, later)
        else:
            for point in later:
                self.waiting.appendValue(point)
            self.handle.registerTimer(ends)
        self.handle.registerTimer(last + self.idle_ms)
        self.moments.update((n, float(mean), float(m2), ends, frozen, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.moments.exists():
            return
        n, mean, m2, ends, frozen, last = self.moments.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not frozen and at >= ends:
            yield self._anomalies(key, n, mean, m2, [tuple(x) for x in self.waiting.get()])
            self.waiting.clear()
            frozen = True
            self.moments.update((n, mean, m2, ends, frozen, last))
        if at >= last + self.idle_ms:
            self.moments.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def replay(events: DataFrame, cases: DataFrame, config: DetectorConfig | None = None, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Z-score anomalies of replayed events, with baselines that the stream itself gives: KEYS, timestamp_ms, value, score.

    ``events`` is a stream of canonical events, at most ``late`` out of order;
    ``cases``: case_id and baseline_end in ms.  A series keeps running moments
    of its points before the baseline's end.  When the watermark passes that,
    they are frozen, and the points that came after it are judged, those that
    waited and then each as it comes: the anomalies of ``detect.detect``,
    wherever the stream is cut into batches and after restarts.  A series
    without a point for ``idle_ms`` is forgotten.  Waiting points are bounded by
    ``late``, moments are one row a series.  Needs ``REPLAY_CONF``.
    """
    config = config or DetectorConfig()
    if config.method != "z_score":
        raise ValueError("a stream has running moments, no quantile")
    rows = build_series(events).join(cases.select("case_id", "baseline_end"), "case_id")
    if config.min_value is not None:
        rows = rows.where((F.col("timestamp_ms") < F.col("baseline_end")) | (F.col("value") >= config.min_value))
    timed = rows.select(*KEYS, "timestamp_ms", "value", "baseline_end", F.timestamp_millis("timestamp_ms").alias("at")).withWatermark("at", late)
    processor = _Replay(float(config.z_threshold), config.min_baseline_samples, idle_ms)
    return timed.groupBy(*KEYS).transformWithStateInPandas(processor, _REPLAYED, "append", "eventTime")
