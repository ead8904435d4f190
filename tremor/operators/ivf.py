"""Nearest vectors by cosine through an inverted-file index: k-means cells, of which a query reads the nearest.

The centroids are fitted on a bounded sample; every row is indexed.  Angles
are a metric, so that a cell can hold nothing nearer than the angle to its
centroid less its radius: after the first probes a search goes on to all cells
that this bound does not rule out, and is exact; without that it is the usual
approximate search, with a recall that tests measure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.store import park, shared_dir

SAMPLE_ROWS = 20_000  # at most so many vectors, the first by a hash of their ids, fit the centroids
QUERY_BLOCK = 2048  # queries that go to all tasks at a time
_FOUND = "query_id string, id string, similarity double"


def _unit(x):
    import numpy as np

    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass(frozen=True)
class Index:
    """cell, id and unit vector v of every row, in folders by cell; centroids and radii (in angles) are the driver's, one for each cell."""

    rows: DataFrame
    centroids: object
    radii: object


def fit(vectors: DataFrame, cells: int, rounds: int = 10):
    """Unit centroids of at most ``cells`` cells, by spherical k-means on a sample of SAMPLE_ROWS rows at most."""
    import numpy as np

    sample = vectors.select("id", "v").where("v is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return np.zeros((0, 0))
    x = _unit(np.array([r["v"] for r in sample], float))
    centroids = x[np.unique(np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int))]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(moved[:, None], _unit(sums), centroids)
    return centroids


def build(vectors: DataFrame, cells: int) -> Index:
    """The index of all rows of ``vectors`` (id: string; v: array of doubles, all of one length; a null v is left out)."""
    import numpy as np

    spark = vectors.sparkSession
    centroids = fit(vectors, cells)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(np.array(batch.column("v").to_pylist(), float))
            near = x @ centroids.T
            own = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("id"), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(angle)], ["cell", "id", "v", "angle"])

    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    placed = vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "cell int, id string, v array<double>, angle double")
    placed.write.partitionBy("cell").parquet(path)
    rows = spark.read.schema("id string, v array<double>, angle double, cell int").parquet(path)
    radii = np.zeros(len(centroids))
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius")).collect():  # a row for each cell
        radii[r["cell"]] = r["radius"]
    return Index(rows, centroids, radii)


def _probe(ids: list[str], queries, wanted, k: int):
    """Best ``k`` rows of each batch for every query that wants the row's cell; ``wanted``: queries x cells."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cell = np.array(batch.column("cell").to_numpy(zero_copy_only=False), int)
            own = batch.column("id").to_pylist()
            x = np.array(batch.column("v").to_pylist(), float)
            out = []
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                if not len(who):
                    continue
                near = np.round(x[at] @ queries[who].T, 9)
                for j, q in enumerate(who):
                    # rows as good as the k-th best stay all, so that ties can be told by id afterwards
                    least = np.partition(near[:, j], len(at) - k - 1)[len(at) - k - 1] if len(at) > k + 1 else -2
                    out += [(ids[q], own[at[i]], float(near[i, j])) for i in np.flatnonzero(near[:, j] >= least) if own[at[i]] != ids[q]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["query_id", "id", "similarity"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """query_id, id, similarity (to 9 decimals) and place of the ``k`` nearest rows of each query (id, v), itself left out.

    Queries go out in blocks; a block reads the folders of the cells that it
    wants.  ``exact`` goes on to the cells whose bound is as good as a query's
    k-th neighbour; without it only the nearest ``probes`` cells are read.
    """
    import numpy as np

    spark = index.rows.sparkSession
    parts: list[DataFrame] = []

    def read(ids, q, wanted):
        cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
        return index.rows.where(F.col("cell").isin(cells)).select("cell", "id", "v").mapInArrow(_probe(ids, q, wanted, k), _FOUND)

    def block(rows) -> None:
        ids = [r["id"] for r in rows]
        q = _unit(np.array([r["v"] for r in rows], float))
        near = q @ index.centroids.T
        first = np.zeros(near.shape, bool)
        nearest = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(first, nearest, True, axis=1)
        found = _best(read(ids, q, first), k)
        if exact:
            found = park(found, "ivf-first")
            worst = {r["query_id"]: r["s"] for r in found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("s")).collect()}  # a row for each query of the block
            bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - index.radii[None, :]))
            kth = np.array([-2.0 if worst.get(i) is None else worst[i] for i in ids])
            more = ~first & (bound + 1e-8 >= kth[:, None])
            if more.any():
                found = _best(found.drop("place").unionByName(read(ids, q, more)), k)
        parts.append(found)

    waiting: list = []
    for row in queries.select(F.col("id").cast("string").alias("id"), "v").where("v is not null").toLocalIterator():
        waiting.append(row)
        if len(waiting) == QUERY_BLOCK:
            block(waiting)
            waiting = []
    if waiting and len(index.centroids):
        block(waiting)
    out = None
    for x in parts:
        out = x if out is None else out.unionByName(x)
    return out if out is not None else spark.createDataFrame([], f"{_FOUND}, place int")
