"""Replayed data as a stream against the batch, for several cuts and a restart."""

import random

import pytest
from pyspark.sql import functions as F
from tremor.config import DetectorConfig
from tremor.operators import detect as D
from tremor.operators import normalize
from tremor.streaming import monitor

MINUTE = 60_000


def data(spark):
    rng = random.Random(11)
    rows = []
    for case, end in (("c1", 100), ("c2", 130)):
        for name in ("a_cpu", "b_mem"):
            rows += [(case, "d", "cpu", "a", MINUTE * k, name, rng.gauss(10, 1) + (8 if k > end and rng.random() < 0.3 else 0)) for k in range(1, 220)]  # a watermark begins at 0, and what is not after it is late
    rows += [("c1", "d", "cpu", "a", MINUTE * k, "few_cpu", 5.0 + (k > 100) * 50) for k in range(94, 220)] + [("c1", "d", "cpu", "a", MINUTE * k, "flat_cpu", 5.0) for k in range(220)]
    rows += [("c3", "d", "cpu", "a", MINUTE * k, "a_cpu", 1.0) for k in range(220)]  # a case that is not known
    df = normalize.normalize_metrics(spark.createDataFrame(rows, "case string, dataset string, fault string, root_cause_service string, timestamp bigint, metric_name string, value double"))
    ends = spark.createDataFrame([("c1", 100 * MINUTE), ("c2", 130 * MINUTE)], "case_id string, baseline_end bigint")
    return df, ends


@pytest.mark.parametrize("cuts, restart", [((70, 150), True), ((99, 101, 131, 180), False)])
def test_same_anomalies_as_the_batch(spark, tmp_path, cuts, restart):
    for k, v in monitor.REPLAY_CONF.items():
        spark.conf.set(k, v)
    df, ends = data(spark)
    config = DetectorConfig(z_threshold=3.0)
    want = {(r.case_id, r.service, r.signal_type, r.timestamp_ms): r.score for r in D.detect(df, ends, config).collect()}
    assert len(want) > 20
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    bounds = [0, *cuts, 10_000]

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        query = monitor.replay(stream, ends, config, late="10 minutes").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
        assert query.awaitTermination(100)
        if query.exception():
            raise query.exception()

    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = df.where((F.col("timestamp_ms") >= a * MINUTE) & (F.col("timestamp_ms") < b * MINUTE))
        part.orderBy(F.hash("event_id")).coalesce(1).write.parquet(f"{source}/{k}")
        if restart:
            run()
    if not restart:
        run()
    got = {(r.case_id, r.service, r.signal_type, r.timestamp_ms): r.score for r in spark.read.parquet(out).collect()}
    assert sorted(want.keys() - got.keys()) == sorted(got.keys() - want.keys()) == [], (len(want), len(got))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_only_moments_can_be_replayed(spark):
    with pytest.raises(ValueError):
        monitor.replay(None, None, DetectorConfig(method="threshold"))
