"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.store import park, shared_dir  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WS = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of about ``size`` for what is written meanwhile: whole texts and blobs make the usual ones heavy
    on both sides of a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if usual is None else spark.conf.set(name, usual)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of Arrow batches, whose worker gives its memory back before it waits for the next task."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied


def routes(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a hash partitioner deals to the partitions 0 to n - 1, one each."""
    span = spark.range(40 * n + 400).select(F.col("id").cast("int").alias("x"))
    rows = span.groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("k")).agg(F.min("x").alias("x")).collect()
    found = dict(map(tuple, rows))
    return [found.get(k, k) for k in range(n)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def crc_sql(number: str) -> str:
    """DuckDB SQL of the crc32 of a number as text (null: empty), bit by bit."""
    of_byte = "list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(a, x))"
    codes = f"case when {number} is null then [] else list_transform(string_split(cast({number} as varchar), ''), lambda x: cast(ascii(x) as bigint)) end"
    return f"xor(list_reduce({codes}, lambda a, x: {of_byte}, cast(4294967295 as bigint)), 4294967295)"


def binaries(batch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def labelled(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``rows`` labelled documents
    outside the held-out fold, chosen by a hash of doc_id; written once for all
    its readers.  Of documents with equal doc_id the smallest text counts, of
    labels that contradict each other the 1; other labels and null ids are left
    out.  The
    bound on the sample (some 20 bytes a row) also bounds what is broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(crc_of_id() % mod != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return park(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), f"labelled-{label}")


def logistic(x, y, l2: float, steps: int = 30):
    """Weights of a logistic regression of ``y`` (0/1) on ``x`` by Newton's method, without an intercept."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - l2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
