"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.store import park


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One half round: every node's neighbours (the larger ones, or the smaller ones and itself) are linked to the
    smallest node that it knows.  The smallest is an aggregate, which combines before the shuffle; the join that
    brings it back may split a node with very many links."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    found = both.where("v > u").join(least, "u").select("v", "m") if larger else both.join(least, "u").where("v <> m").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node that it is linked to, of every node of ``links`` (u, v of one type).

    Large-star and small-star rounds on parked tables until nothing changes: a logarithmic number of them.
    Links of a node with itself and repeated ones change nothing.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, was = park(ordered, "links"), None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was:
            break
        was = state
        big = _stars(now, larger=True)
        now = park(_stars(big, larger=False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
