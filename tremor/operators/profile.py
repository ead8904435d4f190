"""Profiling queries on any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """``order``: key, desc or asc (of the counts, ties by key); None leaves the rows as they come."""
    rows = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    by = {None: (), "key": (column,), "desc": (F.desc("n"), column), "asc": ("n", column)}[order]
    return rows.orderBy(*by) if by else rows


def bars(counts: DataFrame, width: int = 40) -> str:
    """A text bar for each row of a small frame (label, n)."""
    rows = [(str(r[0]), r[1]) for r in counts.collect()]
    most, wide = max((n for _, n in rows), default=1), max((len(x) for x, _ in rows), default=0)
    return "\n".join(f"{x:<{wide}} {'#' * max(1, round(width * n / most))} {n}" for x, n in rows)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, by the sizes of equal groups."""
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def _melt(row: DataFrame, names: list[str], *fields: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, c in enumerate(names)]
    return row.select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame) -> DataFrame:
    """column and nulls, most first."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)])
    return _melt(row, df.columns, "nulls").orderBy(F.desc("nulls"), "column")


def column_profile(df: DataFrame) -> DataFrame:
    """column, dtype, non_null and distinct; each column is counted on its own, so that no row is copied for each
    distinct count, and equal values meet before the shuffle."""
    out = None
    for name, dtype in df.dtypes:
        values = df.groupBy(F.col(f"`{name}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
        row = values.agg(F.lit(name).alias("column"), F.lit(dtype).alias("dtype"), F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"), F.count(F.lit(1)).alias("distinct"))
        out = row if out is None else out.unionByName(row)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)
