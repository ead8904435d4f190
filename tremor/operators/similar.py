"""Nearest vectors by cosine, for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # query vectors that are sent to all tasks at a time
ROWS, QUERIES = 1024, 256  # of a batch and of a block that are compared at a time


def _nearest(ids, queries, k: int):
    """The ``k`` best rows of a task for each query: ``ids`` and unit ``queries`` are arrays, and all that a task
    keeps is k candidates of each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best = np.full((len(ids), k), -np.inf)
        best_id, exact = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                x = unit(matrix(part.column("v")))
                for a in range(0, len(ids), QUERIES):
                    q = slice(a, a + QUERIES)
                    # as they are told apart in the end: by 9 decimals, ties by id
                    raw = queries[q] @ x.T
                    sims = np.round(raw, 9)
                    sims[ids[q][:, None] == own] = -np.inf
                    if len(own) > k:
                        least = np.maximum(np.partition(sims, len(own) - k, axis=1)[:, len(own) - k], best[q, -1])
                    else:
                        least = best[q, -1]
                    for j, c in zip(*_hits(sims >= least[:, None], sims), strict=True):
                        near = np.concatenate([best[a + j], sims[j, c]])
                        who = np.concatenate([best_id[a + j], own[c]])
                        order = np.lexsort((who, -near))[:k]
                        exact[a + j] = np.concatenate([exact[a + j], raw[j, c]])[order]
                        best[a + j], best_id[a + j] = near[order], who[order]
        at, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best_id[at, place]), pa.array(exact[at, place])], ["query_id", "id", "similarity"])

    return run


def _hits(keep, sims):
    """Rows of ``keep`` that hold anything, and for each the columns."""
    import numpy as np

    keep &= sims > -np.inf
    rows = np.flatnonzero(keep.any(axis=1))
    return rows, [np.flatnonzero(keep[j]) for j in rows]


def unit(x):
    import numpy as np

    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column):
    """Vectors of one length without nulls, an Arrow column of lists, as rows of an array."""
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def similar(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity, place: exact nearest rows of every query.

    ``vectors`` and ``queries``: id, v.  Queries go out in blocks; a task keeps
    k candidates of each, so that only those are shuffled, and compares a few
    rows and queries at a time: its memory doesn't grow with batch or block.
    """
    import numpy as np

    out, block = None, []

    def add(rows):
        ids, v = zip(*rows, strict=True)
        part = vectors.mapInArrow(_nearest(np.array(ids, np.int64), unit(np.array(v, float)), k), "query_id bigint, id bigint, similarity double")
        return part if out is None else out.unionByName(part)

    for row in queries.select("id", "v").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            out, block = add(block), []
    if block:
        out = add(block)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
