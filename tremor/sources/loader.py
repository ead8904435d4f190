"""CSV data set of telemetry cases: scans, time windows and case metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor import schemas, store
from tremor.sources import csv_records

FILES = {"metrics": "data/processed/metrics/metrics.csv", "logs": "data/processed/logs/logs.csv", "traces": "data/processed/traces/traces.csv", "ground_truth": "data/ground_truth/target_incidents.csv"}


@dataclass(frozen=True)
class DatasetPaths:
    metrics: str
    logs: str
    traces: str
    ground_truth: str

    @classmethod
    def from_project_root(cls, root: str) -> DatasetPaths:
        return cls(**{k: f"{root.rstrip('/')}/{v}" for k, v in FILES.items()})


@dataclass(frozen=True)
class CaseInfo:
    case_id: str
    dataset: str
    fault: str
    root_cause_service: str
    inject_time_ms: int
    time_start_ms: int
    time_end_ms: int


def case_filter(df: DataFrame, case_id: str | None) -> DataFrame:
    return df if case_id is None else df.where(F.col("case") == case_id)


def window(df: DataFrame, column: str, start_ms: int | None, end_ms: int | None, per_second: bool = True) -> DataFrame:
    """Inclusive at both ends; bounds for a column of seconds are floored to seconds."""
    for bound, keep in ((start_ms, lambda c, v: c >= v), (end_ms, lambda c, v: c <= v)):
        if bound is not None:
            df = df.where(keep(F.col(column), bound // 1000 if per_second else bound))
    return df


def to_ms(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column).cast("bigint") * 1000)


def unpivot(wide: DataFrame) -> DataFrame:
    """Wide metrics to metric_name and value; null values stay."""
    ids = [c for c in (*schemas.METRICS_META, "timestamp") if c in wide.columns]
    values = [c for c in wide.columns if c not in ids]
    doubles = wide.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values])
    return doubles.unpivot([F.col(c) for c in ids], [F.col(f"`{c}`") for c in values], "metric_name", "value")


class DatasetLoader:
    """Lazy frames over the four CSV tables; column types are fixed, not inferred."""

    def __init__(self, spark: SparkSession, paths: DatasetPaths, validate_paths: bool = True):
        self.spark, self.paths = spark, paths
        if validate_paths:
            missing = [p for p in vars(paths).values() if not store.exists(spark, p)]
            if missing:
                raise FileNotFoundError(f"missing data files: {missing}")

    def _csv(self, path: str, schema: str, required, source: str, breaks: bool = False) -> DataFrame:
        """``breaks``: values may hold line breaks; files are read by byte ranges all the same."""
        header = self.spark.read.csv(path, header=True).columns
        kinds = dict(x.split() for x in schema.split(", "))
        declared = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
        df = csv_records.read_csv(self.spark, path, declared) if breaks else self.spark.read.csv(path, header=True, schema=declared, escape='"')
        return schemas.require(df, required, source)

    def quarantined(self, source: str) -> DataFrame:
        """case, file, reason and record of the rows of ``source`` that a load turns into nulls, or cuts: a value that is
        not of its column's type, or too many or too few values.  Loads keep these rows."""
        path = getattr(self.paths, source)
        header = self.spark.read.csv(path, header=True).columns
        if source == "metrics":
            kinds = {c: "string" if c in schemas.CASE else "bigint" if c == "time" else "double" for c in header}
        else:
            fixed = {"logs": schemas.LOG_SCHEMA, "traces": schemas.TRACE_SCHEMA, "ground_truth": schemas.GROUND_TRUTH_SCHEMA}[source]
            kinds = {c: dict(x.split() for x in fixed.split(", ")).get(c, "string") for c in header}
        names = [f"c{i}" for i in range(len(header))]
        declared = ", ".join(f"{n} string" for n in [*names, "wrong"])
        rows = csv_records.records(self.spark, path).where("not first")
        rows = rows.select("file", "text", F.from_csv("text", declared, {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "wrong"}).alias("r"))
        flaws = [F.when(F.col("r.wrong").isNotNull(), F.lit(f"not {len(header)} values"))]
        flaws += [F.when(F.col(f"r.{n}").isNotNull() & F.col(f"r.{n}").try_cast(kinds[c]).isNull(), F.lit(f"{c}: no {kinds[c]}")) for n, c in zip(names, header, strict=True) if kinds[c] != "string"]
        case = F.col(f"r.{names[header.index('case')]}") if "case" in header else F.lit(None).cast("string")
        return rows.select(case.alias("case"), "file", F.array_join(F.array_compact(F.array(*flaws)), "; ").alias("reason"), F.col("text").alias("record")).where("reason <> ''")

    def quarantine_counts(self, source: str) -> DataFrame:
        """case, reason and rows of what ``quarantined`` lists."""
        return self.quarantined(source).groupBy("case", "reason").agg(F.count(F.lit(1)).alias("rows"))

    def get_metric_columns(self) -> list[str]:
        return [c for c in self.spark.read.csv(self.paths.metrics, header=True).columns if c not in schemas.METRICS_META]

    def scan_metrics(self, case_id: str | None = None, *, time_start_ms: int | None = None, time_end_ms: int | None = None, long_format: bool = True) -> DataFrame:
        columns = self.spark.read.csv(self.paths.metrics, header=True).columns
        schema = ", ".join(f"`{c}` {'string' if c in schemas.CASE else 'bigint' if c == 'time' else 'double'}" for c in columns)
        df = schemas.require(self.spark.read.csv(self.paths.metrics, header=True, schema=schema), schemas.METRICS_META, "metrics")
        df = to_ms(window(case_filter(df, case_id), "time", time_start_ms, time_end_ms), "time", "timestamp")
        return unpivot(df) if long_format else df

    load_metrics = scan_metrics

    def load_logs(self, case_id: str | None = None, *, time_start_ms: int | None = None, time_end_ms: int | None = None) -> DataFrame:
        df = self._csv(self.paths.logs, schemas.LOG_SCHEMA, schemas.names(schemas.LOG_SCHEMA), "logs", breaks=True)
        return to_ms(window(case_filter(df, case_id), "timestamp", time_start_ms, time_end_ms), "timestamp", "timestamp_ms")

    def load_traces(self, case_id: str | None = None, *, time_start_ms: int | None = None, time_end_ms: int | None = None) -> DataFrame:
        df = self._csv(self.paths.traces, schemas.TRACE_SCHEMA, schemas.names(schemas.TRACE_SCHEMA), "traces")
        df = window(case_filter(df, case_id), "startTimeMillis", time_start_ms, time_end_ms, per_second=False)
        return df.withColumn("timestamp_ms", F.col("startTimeMillis").cast("bigint"))

    def load_ground_truth(self, case_id: str | None = None) -> DataFrame:
        return case_filter(self._csv(self.paths.ground_truth, schemas.GROUND_TRUTH_SCHEMA, schemas.CASE, "ground truth"), case_id)

    def iter_metrics(self, case_id: str | None = None, *, chunk_size: int = 10_000, **options) -> Iterator[list]:
        """Rows in lists of ``chunk_size``, a partition at a time."""
        if chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        chunk: list = []
        for row in self.scan_metrics(case_id, **options).toLocalIterator():
            chunk.append(row)
            if len(chunk) == chunk_size:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def list_cases(self, first: int | None = None) -> list[str]:
        """All cases in order, or the ``first`` of them."""
        rows = self.load_ground_truth().select("case").where("case is not null").distinct().orderBy("case")
        return [r[0] for r in (rows if first is None else rows.limit(first)).collect()]

    def get_case_info(self, case_id: str) -> CaseInfo:
        row = self.load_ground_truth(case_id).first()
        if row is None:
            raise ValueError(f"unknown case: {case_id}")
        times = [row[c] for c in ("inject_time", "time_start", "time_end")]
        if None in times:
            raise ValueError(f"case without times: {case_id}")
        return CaseInfo(row["case"], row["dataset"], row["fault"], row["root_cause_service"], *(int(float(t) * 1000) for t in times))

    def get_case_time_window(self, case_id: str) -> tuple[int, int, int]:
        info = self.get_case_info(case_id)
        return info.time_start_ms, info.inject_time_ms, info.time_end_ms

    def load_case(self, case_id: str, *, include_metrics: bool = True, include_logs: bool = True, include_traces: bool = True, metrics_long_format: bool = True) -> dict:
        info = self.get_case_info(case_id)
        span = {"time_start_ms": info.time_start_ms, "time_end_ms": info.time_end_ms}
        return {
            "info": info,
            "metrics": self.scan_metrics(case_id, **span, long_format=metrics_long_format) if include_metrics else None,
            "logs": self.load_logs(case_id, **span) if include_logs else None,
            "traces": self.load_traces(case_id, **span) if include_traces else None,
        }


def create_default_loader(spark: SparkSession, project_root: str = ".") -> DatasetLoader:
    return DatasetLoader(spark, DatasetPaths.from_project_root(project_root))
