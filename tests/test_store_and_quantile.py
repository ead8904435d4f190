"""The store of resources and days, and quantiles by refined histograms."""

import random

import pytest
from pyspark.sql import functions as F
from tremor.operators.quantile import quantiles
from tremor.sources import resource_store as R

EVENT = "source string, service_name string, case_id string, timestamp_ms bigint, signal_type string, metric_name string, value double"
DAY = R.DAY_MS


def points(spark, rows):
    df = spark.createDataFrame([("metric", s, c, t, "cpu", f"{s}_cpu", v) for s, c, t, v in rows], EVENT)
    return R.points(df)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_upsert_changes_only_its_folders(spark, tmp_path):
    path = tmp_path / "store"
    rows = [(s, c, d * DAY + k * 1000, float(k)) for s in ("a", "b") for c in ("c1", "c2") for d in range(3) for k in range(20)] + [(None, "c1", 5, 1.0), ("", "c1", 5, 2.0), ("a", "c1", None, 1.0)]
    R.upsert(points(spark, rows), str(path))
    assert sorted(p.name for p in path.iterdir() if p.is_dir()) == ["resource=a", "resource=b", "resource=unknown"]
    before = files(path)
    stored = lambda: sorted(map(tuple, R.read(spark, str(path)).select("resource", "case_id", "timestamp_ms", "value").collect()), key=repr)
    was = stored()
    assert len(was) == 242
    # one case of one resource and day again, with one value changed and one row more
    R.upsert(points(spark, [("a", "c1", DAY + k * 1000, 99.0 if k == 3 else float(k)) for k in range(21)]), str(path))
    after = files(path)
    assert {f.rpartition("/")[0] for f in before ^ after} == {"resource=a/day=1970-01-02"}
    now = stored()
    assert len(now) == 243 and set(now) - set(was) == {("a", "c1", DAY + 3000, 99.0), ("a", "c1", DAY + 20_000, 20.0)} and set(was) - set(now) == {("a", "c1", DAY + 3000, 3.0)}
    R.upsert(points(spark, []), str(path))
    R.upsert(points(spark, [("a", "c1", DAY, 0.0)] * 3), str(path))
    assert stored() == now


def test_reads_only_the_folders_of_a_span(spark, tmp_path):
    path = str(tmp_path / "store")
    R.upsert(points(spark, [("a", "c", d * DAY + 7, float(d)) for d in range(10)] + [("b", "c", 0, 1.0)]), path)
    df = R.read(spark, path, "a", 2 * DAY + 7, 4 * DAY)
    assert sorted(r.value for r in df.collect()) == [2.0, 3.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(resource" in plan and "(day" in plan.split("PushedFilters")[0].split("PartitionFilters")[1]
    assert {f.split("day=")[1].split("/")[0] for f in df.inputFiles() if "resource=a" in f} >= {"1970-01-03", "1970-01-04"}


@pytest.mark.parametrize("q, few", [(0.0, 4096), (0.31, 4096), (0.95, 4096), (0.5, 3), (0.95, 3), (1.0, 3)])
def test_quantiles_equal_percentile(spark, few, q):
    rng = random.Random(9)
    series = {
        "one": [4.0], "two": [1.0, 2.0], "same": [5.0] * 50, "normal": [rng.gauss(0, 1) for _ in range(400)], "heavy": [rng.paretovariate(0.2) for _ in range(300)], "steps": [float(rng.randrange(4)) for _ in range(300)],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1.0 + 2**-52] * 3, "mostly": [0.0] * 200 + [1e9, -1e9, 3.0], "none": [None, None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in series.items() for v in vs], "k string, v double").repartition(3)
    got = {r.k: r["quantile"] for r in quantiles(df, ["k"], "v", q, few).collect()}
    for k, vs in series.items():
        if k == "none":
            assert k not in got
            continue
        vs = sorted(vs)
        at = (len(vs) - 1) * q
        i, part = int(at), at - int(at)
        assert got[k] == vs[i] * (1 - part) + vs[min(i + 1, len(vs) - 1)] * part, k


def test_a_long_series_in_bounded_memory(spark):
    df = spark.range(3_000_000).select(F.lit("s").alias("k"), (F.rand(3) * F.rand(4)).alias("v"))
    (got,) = quantiles(df, ["k"], "v", 0.95).collect()
    (want,) = df.select(F.percentile("v", 0.95)).first()
    assert abs(got["quantile"] - want) < 1e-12
    with pytest.raises(ValueError):
        quantiles(df, ["k"], "v", 1.5)
