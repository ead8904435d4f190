"""CSV whose values may hold line breaks, read by byte ranges.

Spark splits a text file at any byte and gives every physical line to one
split.  Whether a line begins inside quotes depends on all lines before it, so
that a first pass reduces each split to a function of two states (a record
begins, or quotes are open), and a sum over these functions, one row a split,
tells every split its state.  The second pass joins lines to records inside a
split; only what crosses a cut is shuffled, two pieces a split at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.store import park

START, QUOTED = 0, 1


def _after(line: str, state: int) -> int:
    """The state after a line.  A quote opens a value only at its beginning; two in a row inside are one."""
    at = 0
    while True:
        if state == QUOTED:
            at = line.find('"', at)
            if at < 0:
                return QUOTED
            if line.startswith('"', at + 1):
                at += 2
                continue
            at = line.find(",", at + 1)
        elif line.startswith('"', at):
            state, at = QUOTED, at + 1
            continue
        else:
            at = line.find(",", at)
        if at < 0:
            return START
        state, at = START, at + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batch) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of lines of one file and split."""
    file, block, value = (batch.column(i).to_pylist() for i in range(3))
    a = 0
    for b in range(1, len(value) + 1):
        if b == len(value) or (file[b], block[b]) != (file[a], block[a]):
            yield file[a], block[a], value[a:b]
            a = b


def _reduce(batches: Iterator) -> Iterator:
    """file, block and the states that the split ends in, from either state."""
    import pyarrow as pa

    now, ends = None, [START, QUOTED]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([ends[0]], pa.int32()), pa.array([ends[1]], pa.int32())], ["file", "block", "from_start", "from_quoted"])

    for batch in batches:
        for file, block, lines in _splits(batch):
            if now != (file, block):
                if now:
                    yield row()
                now, ends = (file, block), [START, QUOTED]
            for line in lines:
                if '"' in line:
                    ends = [_after(line, s) for s in ends] if ends[0] != ends[1] else [_after(line, ends[0])] * 2
    if now:
        yield row()


_PIECE = "file string, block bigint, piece int, first boolean, text string"


def _assemble(batches: Iterator) -> Iterator:
    """file, block, piece (0: what goes on from the split before, 1: a whole record, 2: the record open at the end),
    first (whether the file begins with it) and text."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    now, state, piece, first = None, START, 0, False
    open_lines: list[str] = []
    rows: list[tuple] = []

    def close(kind: int) -> None:
        nonlocal open_lines, first
        if open_lines:
            rows.append((*now, kind, first, "\n".join(open_lines)))
            first = False
        open_lines = []

    def taken():
        nonlocal rows
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "piece", "first", "text"])
        rows = []
        return batch

    for batch in batches:
        states = batch.column(3).to_pylist()
        at = 0
        for file, block, lines in _splits(batch):
            if now != (file, block):
                close(2 if piece else 0)
                now, state = (file, block), states[at]
                piece, first = int(state == START), block == 0
            at += len(lines)
            for line in lines:
                open_lines.append(line)
                state = _after(line, state) if '"' in line else state
                if state == START:
                    close(piece)
                    piece = 1
        yield taken()
    close(2 if piece else 0)
    yield taken()


def _states(ends: DataFrame) -> DataFrame:
    """file, block and the state that each split begins in: what the last earlier split with one outcome ends in, turned
    once for each split since then that swaps the two states."""
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(F.col("from_start") == F.col("from_quoted"), F.struct("block", "from_start"))
    swaps = F.when((F.col("from_start") == QUOTED) & (F.col("from_quoted") == START), 1).otherwise(0)
    rows = ends.withColumns({"known": F.max(sure).over(by), "turns": F.coalesce(F.sum(swaps).over(by), F.lit(0))})
    rows = rows.withColumn("sure_block", F.col("known.block"))
    earlier = rows.select("file", F.col("block").alias("sure_block"), F.col("turns").alias("earlier"))
    rows = rows.join(earlier, ["file", "sure_block"], "left")
    turned = (F.col("turns") - F.coalesce("earlier", F.lit(0))) % 2
    known = F.coalesce("known.from_start", F.lit(START))
    return rows.select("file", "block", F.when(turned == 1, 1 - known).otherwise(known).cast("int").alias("state"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether the file begins with it) and text of every record, without blank ones.

    A record keeps the line breaks inside it; the carriage return of the line
    break that ends it goes.  Quotes that never close run to the file's end as
    one record, the only thing here that one task holds whole.
    """
    lines = _lines(spark, path)
    ends = park(lines.mapInArrow(_reduce, "file string, block bigint, from_start int, from_quoted int"), "csv-splits")
    # a row for each split of the text, a millionth of its size, and lines stay in their order
    found = lines.join(F.broadcast(_states(ends)), ["file", "block"]).select("file", "block", "value", "state")
    pieces = found.mapInArrow(_assemble, _PIECE)
    order = Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("piece <> 1").withColumn("head", F.max(F.when(F.col("piece") == 2, F.col("block"))).over(order))
    crossing = parts.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("x"), F.bool_or("first").alias("first"))
    whole = pieces.where("piece = 1").select("file", "first", "text").unionByName(crossing.select("file", "first", F.array_join("x.text", "\n").alias("text")))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.withColumn("text", text).where("text <> ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files with a header; ``schema`` lists the columns in the files' order.  A value that is not of its
    column's type is null, and a missing last value too."""
    rows = records(spark, path).where("not first")
    return rows.select(F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
