"""Files on whatever file system Spark has: the shared folder, listings, small texts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without the setting gets a temporary folder; a cluster
    without it is an error, since executors could not see one another's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"tremor-{spark.sparkContext.applicationId}")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def park(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives the loss of executors, and lets several readers use it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _path(spark, path)
    return fs.exists(found)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match ``pattern``, sorted."""
    found, fs = _path(spark, pattern)
    return sorted(x.getPath().toString() for x in fs.globStatus(found) or ())


def files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of what matches ``pattern``, sorted."""
    found, fs = _path(spark, pattern)
    return sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.globStatus(found) or ())


def replace(spark: SparkSession, path: str, by: str) -> None:
    """Move the folder ``by`` to ``path``, in place of what is there."""
    target, fs = _path(spark, path)
    source, _ = _path(spark, by)
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"can't move {by} to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none."""
    return "\n".join(r[0] for r in spark.read.option("lineSep", "\n").text(path).collect()) if exists(spark, path) else None


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, overwritten."""
    found, fs = _path(spark, path)
    out = fs.create(found, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
