"""Message templates, burst scores and lagged correlations on small frames."""

import math

import numpy as np
import pytest
from tremor.operators import correlate
from tremor.operators import logs as L

LOG = "case_id string, timestamp_ms bigint, message string"
SERIES = "case_id string, service string, signal_type string, timestamp_ms bigint, value double"


def templates(spark, messages, depth=2):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "k int, message string")
    return [r.template for r in L.with_template(df, depth).orderBy("k").collect()]


def test_templates_by_a_tree_of_fixed_depth(spark):
    messages = ["user alice logged in", "user bob logged in", "user carol logged in", "user dora logged out", "disk 7 full at 91%", "disk 8 full at 17%", None, "", " \t", "one  two\nthree", "é"]
    assert templates(spark, messages, 1) == ["user <*> logged in", "user <*> logged in", "user <*> logged in", "user <*> logged <*>", "disk <*> full at <*>", "disk <*> full at <*>", "", "", "", "one two three", "é"]
    # two words deep, each name is a leaf of its own
    assert templates(spark, messages[:4], 2) == messages[:4]
    assert templates(spark, ["a b", "a c"], 0) == ["a <*>", "a <*>"] and templates(spark, []) == []


def test_planted_error_comes_first(spark):
    rows = [("c", 10 * k, f"request {k} served in {k} ms") for k in range(200)] + [("c", 1000 + 7 * k, f"connection to 10.0.0.{k} refused") for k in range(30)]
    rows += [("c", 5 * k, "cache warmed up") for k in range(150)] + [("c", None, "no time"), ("d", 5, "of another case"), ("x", 5, "without a pivot"), ("c", 5000, "too late")]
    pivots = spark.createDataFrame([("c", 1000, 0, 2000), ("d", 1000, 0, 2000)], "case_id string, pivot_ms bigint, start_ms bigint, end_ms bigint")
    got = [tuple(r) for r in L.relevant_logs(spark.createDataFrame(rows, LOG), pivots).orderBy("case_id", "place").collect()]
    assert [(r[1], r[2], r[3], r[5]) for r in got if r[0] == "c"] == [("connection to <*> refused", 0, 30, 1), ("request <*> served in <*> ms", 100, 100, 2), ("cache warmed up", 150, 0, 3)]
    assert got[0][4] > 20 and abs(got[1][4]) < 0.1 and got[2][4] < -20 and [r[0] for r in got] == ["c", "c", "c", "d"]
    near = L.relevant_logs(spark.createDataFrame(rows, LOG), pivots, before_ms=100, after_ms=99).where("case_id = 'c'").collect()
    assert {(r.template, r.before, r.after) for r in near} == {("connection to <*> refused", 0, 15), ("request <*> served in <*> ms", 10, 10)}


def test_no_task_holds_all_logs_or_templates_of_a_case(spark):
    from pyspark.sql import functions as F

    letters = "abcdefghij"
    rows = [("c", k, f"{letters[k % 10]} {letters[k // 10 % 10]} {letters[k // 100]} done") for k in range(1000)]
    pivots = spark.createDataFrame([("c", 500, 0, 2000)], "case_id string, pivot_ms bigint, start_ms bigint, end_ms bigint")
    name, was = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(name, "false")
    try:
        got = L.relevant_logs(spark.createDataFrame(rows, LOG), pivots, depth=3).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, was)
    got.sort(key=lambda r: (-r.score, r.template))
    assert len(got) == 1000 and [r.place for r in got] == list(range(1, 1001))  # ties by template
    assert len({r.task for r in got}) > 1 and "_range" not in got[0].asDict()


def test_shared_leaves_without_a_common_word(spark):
    assert templates(spark, ["a b", "c d", "alone in its leaf", "x 1"], 0) == ["<*> <*>", "<*> <*>", "alone in its leaf", "<*> <*>"]


@pytest.mark.parametrize("after, before, la, lb", [(30, 0, 1000, 1000), (5, 5, 300, 900), (0, 9, 10, 10), (1, 100, 5, 500), (2, 3, 7, 11)])
def test_burst_score(spark, after, before, la, lb):
    from pyspark.sql import functions as F

    (got,) = spark.range(1).select(L.burst_score(*[F.lit(x) for x in (after, before, float(la), float(lb))])).first()
    rate = (after + before) / (la + lb)
    loglik = lambda n, mean: (n * math.log(mean) if n else 0) - mean
    own = loglik(after, after or 1e-300) + loglik(before, before or 1e-300) if after and before else loglik(after, after) if after else loglik(before, before)
    want = 2 * (own - loglik(after, rate * la) - loglik(before, rate * lb))
    assert abs(got - (want if after >= rate * la else -want)) < 1e-9


def test_lags_against_numpy(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=200)
    late = np.concatenate([rng.normal(size=3), -2 * ref[:-3]]) + 0.01 * rng.normal(size=200)
    rows = [("c", "a", "cpu", 1000 * t + d, float(v + (0.5 if d else -0.5))) for t, v in enumerate(ref) for d in (0, 400)]  # two points a cell
    rows += [("c", "b", "mem", 1000 * t - 700_000, float(v)) for t, v in enumerate(late)] + [("c", "b", "cpu", 1000 * t, 5.0) for t in range(200)]  # far away; constant
    rows += [("c", "b", "error", 1000 * t, float(v)) for t, v in enumerate(late)] + [("c", "e", "cpu", 1000 * t, float(t)) for t in range(9)] + [("d", "a", "cpu", 1000 * t, float(t)) for t in range(50)]
    one = spark.createDataFrame([("c", "a", "cpu"), ("nowhere", "a", "cpu")], "case_id string, service string, signal_type string")
    got = {(r.service, r.signal_type, r.lag): (r.n, r["corr"], r.place) for r in correlate.lead_lag(spark.createDataFrame(rows, SERIES), one, 1000, 5).collect()}
    assert {k[:2] for k in got} == {("a", "cpu"), ("b", "error")} and len(got) == 22
    for lag in range(-5, 6):
        x, y = (ref[: 200 - lag], late[lag:]) if lag >= 0 else (ref[-lag:], late[: 200 + lag])
        n, corr, _ = got["b", "error", lag]
        assert n == 200 - abs(lag) and abs(corr - np.corrcoef(x, y)[0, 1]) < 1e-6
    assert got["b", "error", 3][2] == 1 and got["b", "error", 3][1] < -0.99 and got["a", "cpu", 0][1:] == (1.0, 1)
    assert correlate.lead_lag(spark.createDataFrame([], SERIES), one, 1000, 5).count() == 0
