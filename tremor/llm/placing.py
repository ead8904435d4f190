"""Numbers of rows within their groups, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import park, partitions, session


def _runs(group: str):
    """Adds _local: how many rows of the same group came before in this sorted partition."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = np.concatenate([[True], codes[1:] != codes[:-1]])
            at = np.arange(len(codes))
            local = at - np.maximum.accumulate(np.where(start, at, 0))
            if keys[0].as_py() == last:  # the batch begins inside a run
                local[: int(np.flatnonzero(start)[1]) if start[1:].any() else len(local)] += seen
            last, seen = keys[-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "_local"])

    return run


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with place, the row's number from 0 in its ``group`` (a column without nulls) by ``order``.

    The rows are range-partitioned by group and order, so that a group of any
    size is spread; equal rows, which are interchangeable, too.  Only a
    partition's first group can go on from the one before: what comes on top
    of its numbers is one row a partition, and is broadcast.
    """
    n = partitions(session(rows))
    stable = park(rows.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    by = [group, *order, "_tie"]
    ranged = stable.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    fields = ", ".join(f"`{c}` {kind}" for c, kind in ranged.dtypes)
    ranged = park(ranged.mapInArrow(_runs(group), f"{fields}, _local bigint"), "ranged")
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(group, "_part", F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    found = ranged.join(F.broadcast(carried), [group, "_part"], "left")
    return found.withColumn("place", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_tie", "_part", "_local", "_before")
