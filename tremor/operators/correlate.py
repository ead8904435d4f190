"""Which series moves first: correlations of a case's series with a reference at several lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.detect import KEYS

LEAST_CELLS = 10


def on_grid(series: DataFrame, step_ms: int) -> DataFrame:
    """Mean value of every series in each cell of ``step_ms``: KEYS, cell, value."""
    return series.groupBy(*KEYS, F.floor(F.col("timestamp_ms") / step_ms).alias("cell")).agg(F.avg("value").alias("value"))


def lead_lag(series: DataFrame, reference: DataFrame, step_ms: int, most: int, least_cells: int = LEAST_CELLS) -> DataFrame:
    """KEYS, lag, n, corr and place: Pearson's correlation of every series of a case with the case's reference series.

    ``series`` as from ``detect.build_series``; ``reference``: KEYS, one
    series a case.  A positive lag means that the series moves so many cells
    after the reference; lags go from -``most`` to ``most``, place 1 is the
    strongest one, of equals the shortest.  Lags with fewer than
    ``least_cells`` common cells, or without variance, have no correlation
    and are left out.

    Points are reduced to cells before anything meets; the reference goes out
    once for each lag and meets the cells of its case and time, and only the
    moments of each lag are shuffled after that.
    """
    cells = on_grid(series, step_ms)
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    own = cells.join(reference.select(*KEYS).distinct(), list(KEYS), "left_semi").select("case_id", "cell", F.col("value").alias("ref"), lags)
    moved = own.select("case_id", (F.col("cell") + F.col("lag")).alias("cell"), "lag", "ref")
    pairs = cells.join(moved, ["case_id", "cell"])
    rows = pairs.groupBy(*KEYS, "lag").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ref", "value").alias("both"), F.stddev_pop("ref").alias("sx"), F.stddev_pop("value").alias("sy"))
    # the round is for ties: moments add up in any order
    rows = rows.where((F.col("n") >= least_cells) & (F.col("sx") > 0) & (F.col("sy") > 0))
    rows = rows.select(*KEYS, "lag", "n", F.round(F.try_divide("both", F.col("sx") * F.col("sy")), 9).alias("corr"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc(F.abs("corr")), F.abs("lag"), "lag")
    return rows.withColumn("place", F.row_number().over(order))
