"""Exact quantiles of very long series in fixed memory, by refining histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.store import park

BINS = 4096
FEW = 4096  # so many values of a series may be looked at together in the end


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Number of the value's bin between the bounds; it never falls as the value grows, and the bounds differ in it.

    Bounds of different sign make three bins by sign; bounds of different
    magnitude equal bins of logarithms, others of values: whatever doubles
    there are, some eight rounds tell them apart."""
    a, b = F.log(F.abs(low)), F.log(F.abs(high))
    far = F.abs(b - a) > 1
    share = F.when(far, (F.log(F.abs(value)) - a) / F.nullif(b - a, F.lit(0.0))).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))
    return F.when((low <= 0) & (high >= 0), F.signum(value) + 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")


def quantiles(rows: DataFrame, keys: list[str], column: str, q: float, few: int = FEW) -> DataFrame:
    """keys and quantile: the linearly interpolated ``q``-quantile of ``column``'s non-null values in each group, exactly.

    Each round counts the group's values in bins between its bounds and keeps the bin of the wanted rank, with its least and largest
    value as new bounds, until that holds ``few`` values at most or one value
    only.  Counts meet on the map side; a group is never gathered, and holds
    at most BINS rows.  The keys must not be null; values are finite.  Groups
    without a value are not in the result.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile must be in [0, 1]")
    values = rows.select(*keys, F.col(column).cast("double").alias("v")).where("v is not null")
    state = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = (F.col("n") - 1) * F.lit(float(q))
    state = state.select(*keys, F.floor(place).alias("rank"), (place - F.floor(place)).alias("part"), "low", "high", F.col("n").alias("held"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    state = park(state, "quantile")
    done = state.where("low = high").select(*keys, "part", F.col("low").alias("x"), F.col("low").alias("y"))
    open_ = state.where("low < high")
    while True:
        small = open_.where(F.col("held") <= few)
        inside = values.join(small, keys).where("v between low and high").groupBy(*keys, "rank", "part").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        at = F.col("rank").cast("int")
        done = done.unionByName(inside.select(*keys, "part", F.get("vs", at).alias("x"), F.coalesce(F.get("vs", at + 1), F.get("vs", at)).alias("y")))
        open_ = open_.where(F.col("held") > few)
        if open_.isEmpty():
            break
        found = values.join(open_, keys).where("v between low and high").groupBy(*keys, "rank", "part", _bin(F.col("v"), F.col("low"), F.col("high")).alias("bin"))
        bins = found.agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        by = Window.partitionBy(*keys).orderBy("bin")
        before = F.coalesce(F.sum("held").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the bin of the wanted rank; if that is the bin's last value, the next one is the least of the following bin
        bins = bins.withColumns({"before": before, "next": F.lead("low").over(by)}).where("rank >= before and rank < before + held")
        bins = bins.withColumn("rank", F.col("rank") - F.col("before")).withColumn("last", F.col("rank") == F.col("held") - 1)
        state = park(bins.select(*keys, "rank", "part", "low", "high", "held", F.when(F.col("last"), F.col("high")).alias("x"), F.when(F.col("last"), F.coalesce("next", "high")).alias("y")), "quantile")
        one = state.where("x is not null or low = high")
        done = done.unionByName(one.select(*keys, "part", F.coalesce("x", "low").alias("x"), F.coalesce("y", "low").alias("y")))
        open_ = state.where("x is null and low < high")
    return done.select(*keys, (F.col("x") * (1 - F.col("part")) + F.col("y") * F.col("part")).alias("quantile"))
