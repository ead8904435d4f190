"""Edge rows of the telemetry operators, on literal frames."""

import math

import pytest
from pyspark.sql import functions as F
from tremor import schemas
from tremor.config import DetectorConfig
from tremor.functions import parsing as P
from tremor.operators import detect as D
from tremor.operators import etl, evaluate, normalize, profile, report
from tremor.sources import loader, sinks
from tremor.streaming import monitor

NAMES = [
    ("checkoutservice_cpu", "checkoutservice", "cpu"), ("ts-auth-service_latency-90", "ts-auth-service", "latency-90"), ("carts-db_diskio", "carts-db", "diskio"), ("a_b_c", "a_b", "c"),
    ("foo", "foo", "foo"), ("foo_", "foo_", None), ("_cpu", "", "cpu"), ("x_cpu\n", "x", "cpu\n"),
]


def test_metric_names(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in NAMES], "n string")
    got = df.select("n", P.service_of(F.col("n")), P.signal_of(F.col("n"))).collect()
    assert [tuple(r) for r in got] == NAMES
    assert P.parse_metric_name(" x_cpu ") == ("x", "cpu") and P.parse_metric_name("foo_") == ("foo", "")
    for bad in ("", "foo", "  "):
        with pytest.raises(ValueError):
            P.parse_metric_name(bad)


def events(spark, values, start=0, fault="cpu", name="svc_cpu"):
    rows = [("c1", "d", fault, "svc", 1000 * (start + i), name, float(v)) for i, v in enumerate(values)]
    return normalize.normalize_metrics(spark.createDataFrame(rows, "case string, dataset string, fault string, root_cause_service string, timestamp bigint, metric_name string, value double"))


def ends(spark, ms):
    return spark.createDataFrame([("c1", ms)], "case_id string, baseline_end bigint")


def test_boundaries_of_z_score(spark):
    base = [9, 11] * 10  # mean 10, std 1
    got = D.detect(events(spark, [*base, 13, 7, 12.99, 10]), ends(spark, 20_000)).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, round(r.score, 9)) for r in got] == [(20_000, 3.0), (21_000, -3.0)]
    assert got[0].event_id == "c1|svc|cpu|20000.0|z_score"
    assert D.detect(events(spark, [*base, 13]), ends(spark, 20_000), DetectorConfig(min_value=14)).count() == 0
    assert D.detect(events(spark, [9] * 9 + [100]), ends(spark, 9_000)).count() == 0


def test_constant_baseline_and_non_finite(spark):
    df = events(spark, [5] * 10 + [500, math.nan, math.inf, -math.inf])
    assert D.detect(df, ends(spark, 10_000)).count() == 0
    assert [r.value for r in D.detect(df, ends(spark, 10_000), DetectorConfig(method="threshold")).collect()] == [500.0]
    assert D.build_series(df).count() == 11


def test_without_baseline_end_all_points_are_evaluated(spark):
    df = events(spark, [100, *[1, 2] * 5, *[1, 2] * 5])
    points = D.in_baseline(D.build_series(df), None)
    assert points.where("in_baseline").count() == 10 and points.where("evaluated").count() == 21


def test_quantile_and_empty_names(spark):
    df = events(spark, [1, 2, 3, 4, 10], name="_cpu")
    row = D.baselines(D.in_baseline(D.build_series(df), ends(spark, 9_000))).first()
    assert row.service == "unknown" and abs(row["quantile"] - 8.8) < 1e-9


def test_config_is_checked():
    for bad in ({"method": "x"}, {"z_threshold": 0}, {"threshold_quantile": 0}, {"threshold_quantile": 1.1}, {"min_baseline_samples": 1}):
        with pytest.raises(ValueError):
            DetectorConfig(**bad)


def test_missing_columns_and_empty(spark):
    with pytest.raises(ValueError, match="message"):
        normalize.normalize_logs(spark.createDataFrame([], "case string"))
    assert normalize.normalize_all(spark).columns == schemas.EVENT_COLUMNS
    assert normalize.normalize_all(spark).schema == schemas.empty_events(spark).schema


def test_verdicts_keep_cases_without_anomalies(spark):
    truth = spark.createDataFrame([("c1", "d", "cpu", "svc", 20, 0, 40), ("c2", "d", "odd", None, 20, 0, 40)], "case string, dataset string, fault string, root_cause_service string, inject_time bigint, time_start bigint, time_end bigint")
    found = evaluate.run_evaluation(events(spark, [9, 11] * 10 + [13] * 4), truth, total_points=spark.createDataFrame([("c1", 24)], "case_id string, n bigint"))
    one, two = found["cases"].orderBy("case_id").collect()
    assert (one.true_positives, one.precision, one.total_faulty_points, one.delay_seconds, one.detected_services, one.root_cause_detected) == (4, 1.0, 12, 0.0, ["svc"], True)
    assert (two.detected, two.precision, two.recall, two.f1_score, two.incident_type, two.detection_method) == (False, 0.0, 0.0, 0.0, None, None)
    text = report.format_report(report.results(found, DetectorConfig()))
    assert "c2: missed" in text and "unknown: 0/1" in text
    none = evaluate.aggregate(found["cases"].where("false")).first()
    assert none.total_cases == 0 and none.detection_rate == 0.0 and none.avg_delay_seconds is None
    cases = evaluate.case_windows(truth)
    edge = spark.createDataFrame([("c1", 25_000, "svc", "z_score")], "case_id string, timestamp_ms bigint, service string, method string")
    assert evaluate.validate_detection(cases, edge, 5000).where("detected").count() == 1
    assert evaluate.validate_detection(cases, edge, 4999).where("detected").count() == 0


def test_bursts_on_foreign_signals_leave_a_case_missed(spark):
    truth = spark.createDataFrame([(c, "d", f, "svc", 20, 0, 40) for c, f in (("c1", "cpu"), ("c2", "delay"), ("c3", "odd"))], "case string, dataset string, fault string, root_cause_service string, inject_time bigint, time_start bigint, time_end bigint")
    rows = [(c, "d", f, "svc", 1000 * k, name, float(v)) for c, f, name in (("c1", "cpu", "svc_mem"), ("c2", "delay", "svc_cpu"), ("c2", "delay", "db_latency-50"), ("c3", "odd", "svc_mem")) for k, v in enumerate([9, 11] * 10 + [50] * (1 if "50" in name else 4))]
    df = normalize.normalize_metrics(spark.createDataFrame(rows, "case string, dataset string, fault string, root_cause_service string, timestamp bigint, metric_name string, value double"))
    got = {r.case_id: (r.detected, r.true_positives, r.detected_services) for r in evaluate.run_evaluation(df, truth)["cases"].collect()}
    assert got == {"c1": (False, 0, []), "c2": (True, 1, ["db"]), "c3": (True, 4, ["svc"])}  # an unknown incident restricts nothing


def test_dependencies(spark):
    rows = [("c", "1", None, "a", 1), ("c", "1", None, "b", 2), ("c", "2", "1", "x", 3), ("c", "3", "2", "x", 4), ("c", "4", "9", "y", 5), ("c", "5", "1", None, 6), ("d", "6", "1", "y", 7)]
    df = spark.createDataFrame(rows, "case string, spanID string, parentSpanID string, serviceName string, time bigint")
    assert [tuple(r) for r in etl.dependencies(df).collect()] == [("b", "x")]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert {tuple(r) for r in etl.reachable(ring).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2), ("a", "a", 3), ("b", "b", 3), ("c", "c", 3)}


def test_csv_loader(spark, tmp_path):
    paths = {k: str(tmp_path / f"{k}.csv") for k in ("metrics", "logs", "traces", "ground_truth")}
    files = {
        "metrics": "case,dataset,fault,root_cause_service,time,a_cpu,b_mem\nc1,d,cpu,a,1,0.5,\nc1,d,cpu,a,2,1.5,7\nc2,d,cpu,a,1,2,3\n",
        "logs": 'case,dataset,fault,root_cause_service,timestamp,container_name,message\nc1,d,cpu,a,1,box,"two\nlines, ""quoted"""\n',
        "traces": "case,dataset,fault,root_cause_service,time,traceID,spanID,serviceName,methodName,operationName,parentSpanID,startTimeMillis,startTime,duration,statusCode\nc1,d,cpu,a,1,t,s,a,m,o,,1500,1500000,2.5,0\n",
        "ground_truth": "case,dataset,fault,root_cause_service,inject_time,time_start,time_end\nc1,d,cpu,a,2,1,3\nc2,d,cpu,a,2,1,3\n",
    }
    with pytest.raises(FileNotFoundError):
        loader.DatasetLoader(spark, loader.DatasetPaths(**paths))
    for k, text in files.items():
        sinks.write_text(spark, text, paths[k])
    data = loader.DatasetLoader(spark, loader.DatasetPaths(**paths))
    assert data.list_cases() == ["c1", "c2"] and data.get_metric_columns() == ["a_cpu", "b_mem"]
    assert data.get_case_time_window("c1") == (1000, 2000, 3000)
    assert data.scan_metrics("c1").count() == 4
    assert data.scan_metrics("c1", time_start_ms=1500, time_end_ms=1999, long_format=False).count() == 1
    assert data.load_logs().first().message == 'two\nlines, "quoted"'
    assert [len(x) for x in data.iter_metrics(chunk_size=4)] == [4, 2]
    with pytest.raises(ValueError):
        next(data.iter_metrics(chunk_size=0))
    got = normalize.normalize_case(data, "c1").collect()
    assert [(r.source, r.service_name) for r in got] == [("log", "box"), ("metric", "a"), ("metric", "b"), ("trace", "a"), ("metric", "a"), ("metric", "b")]
    assert got[3].event_id == "trace:c1:s:0"


def test_rows_are_numbered_by_a_total_order_across_minutes(spark):
    rows = [(c, None if k == 0 else 40_000 * (k % 7) + k % 2, "box", f"m{k % 5}") for c in ("c1", None) for k in range(30)]
    df = spark.createDataFrame([(c, "d", "f", "s", *x) for c, *x in rows], "case string, dataset string, fault string, root_cause_service string, timestamp_ms bigint, container_name string, message string")
    got = normalize._with_row_id(df, "timestamp_ms", "container_name", "message").collect()
    for case in ("c1", None):
        own = sorted((r for r in got if r.case == case), key=lambda r: r._row_id)
        assert [r._row_id for r in own] == list(range(30))
        key = [(r.timestamp_ms is not None, r.timestamp_ms or 0, r.container_name, r.message) for r in own]
        assert key == sorted(key)


def test_events_as_objects(spark):
    first = next(normalize.to_events(events(spark, [1.5])))
    assert (first.case_id, first.timestamp_ms, first.service_name, first.value, first.message) == ("c1", 0, "svc", 1.5, None)
    with pytest.raises(ValueError):
        next(normalize.to_events(spark.createDataFrame([], "case_id string")))


def test_scenarios(spark):
    truth = spark.createDataFrame([("c1", "d", "cpu", "svc", 20, 0, 40), ("c2", "d", "delay", "svc", 20, 0, 40)], "case string, dataset string, fault string, root_cause_service string, inject_time bigint, time_start bigint, time_end bigint")
    found = spark.createDataFrame([("c1", 25_000, "cpu_saturation"), ("c1", 26_000, "cpu_saturation"), ("c2", 25_000, "network_failure"), ("c2", 1000, "db_latency")], "case_id string, timestamp_ms bigint, incident_type string")
    checked = evaluate.scenario_check(evaluate.case_windows(truth), found)
    assert [(r.after, r.before, r.incident_types, r.passed) for r in checked.orderBy("case_id").collect()] == [(2, 0, ["cpu_saturation"], True), (1, 1, ["network_failure"], False)]
    assert tuple(evaluate.group_acceptance(checked).first()) == (2, 1, 1, False)
    assert tuple(evaluate.group_acceptance(checked.where("case_id = 'c1'")).first()) == (1, 2, 0, True)
    assert evaluate.group_acceptance(checked.where("false")).first().accepted is False


def test_cases_by_telemetry(spark):
    cases = spark.createDataFrame([("c1", "cpu"), ("c2", "loss")], "case string, fault string")
    logs = spark.createDataFrame([("c1",), ("c1",), ("c3",)], "case string")
    assert [r.case for r in etl.semi(cases, logs).collect()] == ["c1"]
    assert [r.case for r in etl.without_telemetry(cases, logs).collect()] == ["c2"]


def test_reach_has_no_bound(spark):
    chain = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(7)], "source string, target string")
    got = {tuple(r) for r in etl.reachable(chain).collect()}
    assert got == {(f"s{a}", f"s{b}", b - a) for a in range(8) for b in range(a + 1, 8)}
    assert etl.reachable(chain.where("false")).count() == 0


def raw_tree(spark, root):
    """Three cases: one whole, one with metrics that can't be read and no logs, one without a folder."""
    for case in ("c1", "c2"):
        spark.createDataFrame([(t, 1.0 * t, 2.0) for t in range(20)], "time bigint, svc_cpu double, `other_latency-90` double").coalesce(1).write.parquet(f"{root}/tmp-{case}")
        (root / case).mkdir()
        part = next((root / f"tmp-{case}").glob("part-*"))
        part.rename(root / case / "metrics.parquet")
    (root / "c2" / "metrics.parquet").write_bytes(b"no parquet")
    spans = "spanID string, serviceName string, parentSpanID string, time bigint"
    for case, rows in (("c1", [("1", "a", None, 1), ("2", "b", "1", 2), ("3", None, "1", 3)]), ("c2", [("1", "b", None, 1), ("2", "c", "1", 2)])):
        spark.createDataFrame(rows, spans).coalesce(1).write.parquet(f"{root}/tmp-spans-{case}")
        next((root / f"tmp-spans-{case}").glob("part-*")).rename(root / case / "traces.parquet")
    return spark.createDataFrame([("c1", "RE2-OB", "cpu", "a"), ("c2", "RE2-SS", "loss", "b"), ("c3", "RE2-TT", "delay", "c")], "case string, dataset string, fault string, root_cause_service string")


@pytest.mark.parametrize("indexed", [False, True])
def test_dataset_build(spark, tmp_path, indexed):
    raw, out = tmp_path / "raw", f"{tmp_path}/out"
    raw.mkdir()
    subset = raw_tree(spark, raw)
    if indexed:
        subset.selectExpr("*", "20 as inject_time", "'x' as unwanted").union(subset.selectExpr("'c9' as c", "dataset", "fault", "root_cause_service", "1", "'x' as x")).write.parquet(f"{raw}/cases.parquet")
    got = etl.build_dataset(spark, str(raw), subset, out)
    assert got["rows"] == {"cases": 3, "metrics": 20, "logs": 0, "traces": 5, "services": 3, "dependencies": 2}
    assert got["missing"] == {"metrics": ["c2", "c3"], "logs": ["c1", "c2", "c3"], "traces": ["c3"]}
    assert all(got["files"].values()) and len(got["files"]) == 9
    ((file, reason),) = got["quarantined"].items()  # one broken file among three
    assert file.endswith("/c2/metrics.parquet") and reason
    (broken,) = spark.read.csv(f"{out}/quarantine", header=True, escape='"').collect()
    assert (broken.case, broken.file) == ("c2", file)
    truth = spark.read.csv(f"{out}/ground_truth", header=True)
    assert truth.columns == ["case", "dataset", "fault", "root_cause_service", *(["inject_time"] if indexed else [])] and truth.count() == 3
    assert [tuple(r) for r in spark.read.csv(f"{out}/dependencies", header=True).collect()] == [("a", "b"), ("b", "c")]
    assert [r.service for r in spark.read.csv(f"{out}/services", header=True).collect()] == ["a", "b", "c"]
    assert {(r.incident_type, r.case) for r in spark.read.csv(f"{out}/incidents", header=True).collect()} == {("cpu_saturation", "c1"), ("network_failure", "c2"), ("db_latency", "c3")}
    assert spark.read.csv(f"{out}/inventory", header=True).count() == 3
    assert spark.read.parquet(f"{out}/metrics").select("dataset", "fault", "root_cause_service").distinct().count() == 1
    with pytest.raises(ValueError, match="fault"):
        etl.build_dataset(spark, str(raw), subset.drop("fault"), out)


def test_a_killed_build_goes_on(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    subset = raw_tree(spark, raw)
    write = sinks.write_telemetry

    def killed(df, path):
        if "/traces-" in path:
            raise KeyboardInterrupt
        write(df, path)

    monkeypatch.setattr(sinks, "write_telemetry", killed)
    with pytest.raises(KeyboardInterrupt):
        etl.build_dataset(spark, str(raw), subset, str(out))
    made = {p: p.stat().st_mtime_ns for p in (out / "metrics").rglob("*") if p.is_file()}
    assert made and not (out / "traces").exists()
    written = []
    monkeypatch.setattr(sinks, "write_telemetry", lambda df, path: written.append(path.split("/")[-1].split("-")[0]) or write(df, path))
    whole = etl.build_dataset(spark, str(raw), subset, str(out))
    assert written == ["traces"] and whole["rows"]["metrics"] == 20 and whole["rows"]["traces"] == 5 and len(whole["quarantined"]) == 1
    assert {p: p.stat().st_mtime_ns for p in (out / "metrics").rglob("*") if p.is_file()} == made
    assert etl.build_dataset(spark, str(raw), subset, str(out)) == whole and written == ["traces"]
    # what a table is made from has changed: that table only
    (raw / "c2" / "metrics.parquet").write_bytes((raw / "c1" / "metrics.parquet").read_bytes())
    again = etl.build_dataset(spark, str(raw), subset, str(out))
    assert written == ["traces", "metrics"] and again["rows"]["metrics"] == 40 and again["quarantined"] == {}


def test_evaluation_on_disk(spark, tmp_path):
    import json

    from tremor import evaluation

    root = str(tmp_path)
    metrics = "".join(f"{c},d,{f},svc,{t},{50 if t >= 20 else 9 + t % 2 * 2}\n" for c, f in (("c1", "cpu"), ("c2", "delay"), ("c3", "cpu")) for t in range(60))
    files = {
        loader.FILES["metrics"]: "case,dataset,fault,root_cause_service,time,svc_cpu\n" + metrics,
        loader.FILES["logs"]: "case,dataset,fault,root_cause_service,timestamp,container_name,message\n",
        loader.FILES["traces"]: ",".join(schemas.names(schemas.TRACE_SCHEMA)) + "\n",
        loader.FILES["ground_truth"]: "case,dataset,fault,root_cause_service,inject_time,time_start,time_end\nc1,d,cpu,svc,20,0,40\nc2,d,delay,svc,20,0,40\nc3,d,cpu,svc,,0,40\nc4,d,cpu,svc,50,0,40\n",
    }
    for path, text in files.items():
        sinks.write_text(spark, text, f"{root}/{path}")
    data = loader.create_default_loader(spark, root)
    assert data.list_cases(2) == ["c1", "c2"]
    found = evaluation.run_evaluation(spark, data, output_dir=f"{root}/out")
    assert [c["case_id"] for c in found["cases"]] == ["c1", "c2"] and sorted(found["skipped"]) == ["c3", "c4"]
    assert found["cases"][0]["true_positives"] == 21 and found["aggregate"]["detected_cases"] == 1  # c2 is a delay: its burst of CPU doesn't count
    on_disk = json.loads((tmp_path / "out/detection_results.json").read_text())
    assert on_disk["config"]["method"] == "z_score" and len(on_disk["cases"]) == 2
    assert "c4: the injection is outside" in (tmp_path / "out/detection_report.txt").read_text()
    with pytest.raises(SystemExit):
        evaluation.main(["--method", "none"])


def test_orders_of_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "x string")
    assert [r.x for r in profile.value_counts(df, "x", "desc").collect()] == ["b", "a", "c"]
    assert [r.x for r in profile.value_counts(df, "x", "asc").collect()] == ["a", "c", "b"]
    assert profile.bars(profile.value_counts(df, "x", "key"), 4).splitlines() == ["a ## 1", "b #### 2", "c ## 1"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    assert profile.duplicate_rows(df).first()[0] == 1
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("x", 0), ("y", 1)}
    assert {(r["column"], r.non_null, r.distinct) for r in profile.column_profile(df).collect()} == {("x", 3, 2), ("y", 2, 1)}


def test_streaming_anomalies(spark, tmp_path):
    df = events(spark, [9, 11] * 10 + [13, 7, 10])
    stats = D.baselines(D.in_baseline(D.build_series(df), ends(spark, 20_000))).cache()
    df.where("timestamp_ms >= 20000").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = monitor.anomaly_counts(monitor.detect_stream(stream, stats))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("anomaly_counts").start()
    run.processAllAvailable()
    run.stop()
    assert [r.anomalies for r in spark.table("anomaly_counts").collect()] == [2]
