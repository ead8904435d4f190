"""Dataset build: case selection, telemetry with case constants, topology."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tremor import store
from tremor.config import FAULT_TO_INCIDENT
from tremor.schemas import CASE, GROUND_TRUTH_SCHEMA, LOG_SCHEMA, METRICS_META, TRACE_SCHEMA, names, require
from tremor.sources import sinks


def available(df: DataFrame, wanted) -> DataFrame:
    """The wanted columns that exist, in their order."""
    return df.select(*[c for c in wanted if c in df.columns])


def incident_class(cases: DataFrame, incident: str) -> DataFrame:
    return cases.where(F.col("fault").isin(*[f for f, i in FAULT_TO_INCIDENT.items() if i == incident]))


def semi(cases: DataFrame, subset: DataFrame) -> DataFrame:
    return cases.join(subset.select("case").distinct(), "case", "left_semi").select(*cases.columns)


def with_case(telemetry: DataFrame, cases: DataFrame) -> DataFrame:
    """Case constants as the first columns; ``cases`` is a dimension of one row per case."""
    own = [c for c in telemetry.columns if c not in CASE]
    return telemetry.select("case", *own).join(cases.select(*CASE), "case").select(*CASE, *own)


def without_telemetry(cases: DataFrame, telemetry: DataFrame) -> DataFrame:
    return cases.join(telemetry.select("case").distinct(), "case", "left_anti").select(*cases.columns)


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of differing schemas; missing columns are null."""
    for x in others:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def read_case_files(spark: SparkSession, raw: str, name: str, files: list[str] | None = None) -> DataFrame:
    """``raw``/*/``name``.parquet (or these ``files``) in one scan, the folder's name as case."""
    df = spark.read.option("mergeSchema", "true").parquet(*(files or [f"{raw}/*/{name}.parquet"]))
    case = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(case.alias("case"), *[c for c in df.columns if c != "case"])


def unreadable(spark: SparkSession, files: list[str]) -> list[tuple[str, str]]:
    """The Parquet files that can't be read to their end, with the reason.

    All files are read in one job; only if that fails, each half is, and so on,
    so that few broken files among many cost few jobs."""
    if not files:
        return []
    try:
        df = spark.read.option("mergeSchema", "true").parquet(*files)
        df.agg(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).collect()
        return []
    except (PySparkException, Py4JJavaError) as e:
        if len(files) == 1:
            return [(files[0], str(e).strip().splitlines()[0][:300])]
        half = len(files) // 2
        return unreadable(spark, files[:half]) + unreadable(spark, files[half:])


def services(traces: DataFrame) -> DataFrame:
    return traces.where("serviceName is not null").select(F.col("serviceName").alias("service")).distinct()


def dependencies(traces: DataFrame) -> DataFrame:
    """Edges source -> target of parent and child spans.

    Among spans of one case and id the last counts, by time and then by
    service; spans without a service are left out on both sides.  Ids are
    sorted by a hash of them: they begin alike, and comparing them as texts
    takes several times as long.
    """
    spans = traces.where("serviceName is not null")
    order = [c for c in ("time", "startTimeMillis", "startTime", "serviceName") if c in spans.columns]

    def keys(span: str) -> list[Column]:
        return [F.xxhash64("case", span).alias("key"), F.col(span).alias("span"), F.col("case")]

    # the last span by an aggregate, which combines before the shuffle, not by a window over the id
    parents = spans.groupBy(*keys("spanID")).agg(F.max(F.struct(*order))["serviceName"].alias("source"))
    children = spans.where("parentSpanID is not null").select(*keys("parentSpanID"), F.col("serviceName").alias("target"))
    edges = children.join(parents, ["key", "span", "case"]).where("source <> '' and source <> target")
    return edges.select("source", "target").distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """source, target, hops: services that depend on one another, by the fewest steps.

    The edges are written once; each round extends only the pairs that the one
    before found, until there are none.
    """
    step = store.park(edges.select("source", "target").distinct(), "edges")
    onward = step.select(F.col("source").alias("via"), "target")
    found = near = step.withColumn("hops", F.lit(1))
    hops = 1
    while not near.isEmpty():
        hops += 1
        further = near.select("source", F.col("target").alias("via")).join(onward, "via").select("source", "target").distinct()
        near = store.park(further.join(found, ["source", "target"], "left_anti").withColumn("hops", F.lit(hops)), "reached")
        found = found.unionByName(near)
    return found


def first_deviation(anomalies: DataFrame) -> DataFrame:
    """Series of a case by the time of their first anomaly."""
    first = anomalies.groupBy("case_id", "service", "signal_type").agg(F.min("timestamp_ms").alias("first_ms"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("first_ms", "service", "signal_type")))


def incident_nodes(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("case_id", "service", "incident_type").agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count(F.lit(1)).alias("anomalies"), F.max(F.abs("score")).alias("peak_score"))


def logs_near(logs: DataFrame, cases: DataFrame, before_ms: int, after_ms: int) -> DataFrame:
    """Log events around each case's injection: an equi-join on the case with an interval."""
    rows = logs.join(cases.select("case_id", "inject_time_ms"), "case_id")
    return rows.where(F.col("timestamp_ms").between(F.col("inject_time_ms") - before_ms, F.col("inject_time_ms") + after_ms))


def case_index(spark: SparkSession, raw: str, subset: DataFrame) -> DataFrame:
    """The cases of the subset as the index (``raw``/cases.parquet) has them; without one, the subset itself."""
    path = f"{raw}/cases.parquet"
    cases = semi(spark.read.parquet(path), subset) if store.exists(spark, path) else subset
    return available(cases, names(GROUND_TRUTH_SCHEMA))


class _Build:
    """Steps of a build, each with one folder, that are not done again.

    A step writes beside the others; its folder is then moved into place and
    its report written, which is what counts as done.  A build that was killed
    goes on with the first step that is not; a step whose token (what it was
    made from) has changed is done anew.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def step(self, name: str, token: list, write: Callable[[str], dict]) -> dict:
        manifest = f"{self.out}/_manifest/{name}.json"
        known = store.read_text(self.spark, manifest)
        if known is not None and (found := json.loads(known))["token"] == token and store.exists(self.spark, f"{self.out}/{name}"):
            return found["report"]
        staged = f"{self.out}/_staging/{name}-{uuid.uuid4().hex}"
        report = write(staged)
        store.replace(self.spark, f"{self.out}/{name}", staged)
        sinks.write_text(self.spark, json.dumps({"token": token, "report": report}), manifest)
        return report


def build_dataset(spark: SparkSession, raw: str, subset: DataFrame, out: str) -> dict:
    """The whole build: class files, ground truth, unified telemetry, topology, inventory and quarantine.

    ``raw`` holds a folder for each case with metrics, logs and traces in
    Parquet, ``subset`` the wanted cases.  Returns the rows by table, the cases
    that lack a source, the files that could not be read with their reasons,
    and the status of each written path.  Such a file is left out as a whole,
    listed in ``out``/quarantine, and its case counts as one without that
    source.  A source that no case has is written as an empty table.  After a
    failure the next call goes on where it ended.
    """
    require(subset, CASE, "subset")
    build = _Build(spark, out)
    whole = subset.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in subset.columns]))).first()
    token = [*whole, *subset.columns]
    build.step("incidents", token, lambda path: sinks.write_incident_classes(subset, path) or {})
    index = list(store.files(spark, f"{raw}/cases.parquet")) + list(store.files(spark, f"{raw}/cases.parquet/*"))
    build.step("ground_truth", [*token, *map(list, index)], lambda path: sinks.write_csv(case_index(spark, raw, subset), path) or {})
    build.step("inventory", token, lambda path: sinks.write_csv(subset, path) or {})
    report: dict = {"rows": {"cases": whole[0]}, "missing": {}, "quarantined": {}}
    empty = {"metrics": ", ".join(f"{c} {'bigint' if c == 'time' else 'string'}" for c in METRICS_META), "logs": LOG_SCHEMA, "traces": TRACE_SCHEMA}
    for name, schema in empty.items():
        files = [list(x) for x in store.files(spark, f"{raw}/*/{name}.parquet")]

        def telemetry(path: str, name: str = name, schema: str = schema, files: list = files) -> dict:
            bad: list[tuple[str, str]] = []

            def write(good: list[str]) -> DataFrame:
                rows = with_case(read_case_files(spark, raw, name, good), subset) if good else spark.createDataFrame([], schema)
                sinks.write_telemetry(rows, path)
                return rows

            paths = [x[0] for x in files]
            try:
                rows = write(paths)
            except (PySparkException, Py4JJavaError):
                bad = unreadable(spark, paths)
                if not bad:
                    raise
                rows = write([p for p in paths if p not in dict(bad)])
            written = spark.read.schema(rows.schema).parquet(path)
            missing = [r[0] for r in without_telemetry(subset, written).select("case").distinct().orderBy("case").collect()]
            return {"rows": written.count(), "missing": missing, "quarantined": dict(bad), "schema": rows.schema.json()}

        own = build.step(name, [*token, *files], telemetry)
        report["rows"][name], report["missing"][name] = own["rows"], own["missing"]
        report["quarantined"] |= own["quarantined"]
        if name == "traces":
            written = spark.read.schema(StructType.fromJson(json.loads(own["schema"]))).parquet(f"{out}/{name}")
            spans = available(written, ("case", "spanID", "serviceName", "parentSpanID"))
            edges = dependencies(spans).select(F.col("source").alias("source_service"), F.col("target").alias("target_service"))
            for table, rows in (("services", services(spans).orderBy("service")), ("dependencies", edges.orderBy("source_service", "target_service"))):
                report["rows"][table] = build.step(table, [*token, *files], lambda path, rows=rows: sinks.write_csv(rows, path) or {"rows": rows.count()})["rows"]
    broken = spark.createDataFrame([(f.split("/")[-2], f, reason) for f, reason in sorted(report["quarantined"].items())], "case string, file string, reason string")
    build.step("quarantine", [list(x) for x in sorted(report["quarantined"].items())], lambda path: sinks.write_csv(broken, path) or {})
    report["files"] = sinks.generated_files(spark, [f"{out}/{x}" for x in ("incidents", "ground_truth", "inventory", *empty, "services", "dependencies", "quarantine")])
    return report


def main(arguments: list[str] | None = None) -> None:
    """python -m tremor.operators.etl RAW SUBSET_CSV OUT"""
    import argparse

    from tremor import session

    parser = argparse.ArgumentParser(description="Build the data set of incident cases")
    for name in ("raw", "subset", "out"):
        parser.add_argument(name)
    args = parser.parse_args(arguments)
    spark = session.build("dataset-build")
    print(json.dumps(build_dataset(spark, args.raw, spark.read.csv(args.subset, header=True, escape='"'), args.out), indent=2))


if __name__ == "__main__":
    main()
