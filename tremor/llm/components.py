"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import park

MOST_ROUNDS = 60


def _contract(batches):
    """Within a task: every node linked to the smallest that its task's edges lead to."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    def rows():
        nodes = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            low, high = min(a, b), max(a, b)
            root[high] = root[low] = low
        if len(root) > 2_000_000:
            yield rows()
            root.clear()
    yield rows()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of ``edges`` (a, b).

    Alternates large-star and small-star rounds until nothing changes; minima
    are pre-aggregated, so a node with very many links costs no single task.
    """
    links = park(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a bigint, b bigint"), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy(F.col("u").alias("of_u")).agg(F.min("v").alias("low")).select("of_u", F.least("of_u", "low").alias("low"))
        large = both.where("v > u").join(low, F.col("u") == F.col("of_u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = park(large.where("a <> b").distinct(), "links")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy(F.col("u").alias("of_u")).agg(F.min("v").alias("low"))
        small = down.join(low, F.col("u") == F.col("of_u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        links = park(small.unionByName(low.select(F.col("of_u").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
