"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target fixes how often, on average, its documents are taken:
floor(target / size) times for certain and once more with the fractional rest
as inclusion probability.  The cube method settles those probabilities: its
flight phase moves them through the null space of the balancing constraints
(document total and word total of the source), so that both totals stay what
they are while ever more probabilities become 0 or 1.  Flights run in parallel
over chunks of a source, each leaving two documents at most; what is left is
chunked again, until one small landing problem per source remains: the last
documents and the largest of the last chunk, which are kept out of the flight
so that their sums of words come near any target.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import park, table

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
CHUNK = 4096
LANDING = 14  # documents that are kept for the landing
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, size bigint, src int, times int, p double, copy bigint"
BROADCAST_KEYS = 1_000_000  # keys of repeated rows (8 bytes each) that are sent to all tasks; more are joined


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Target of each (source, size), given in code point order with null last."""
    weigh = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list[Fraction | None] = [None] * len(sizes)
    left = share * sum(n for _, n in sizes)
    while open_ := [i for i, x in enumerate(out) if x is None]:
        unit = left / sum(weigh[i] for i in open_)
        over = [i for i in open_ if weigh[i] * unit > most * sizes[i][1]]
        for i in over or open_:
            out[i] = Fraction(most * sizes[i][1]) if over else weigh[i] * unit
            left -= out[i]
    return out


def flight(sizes: list[int], p: list[float], draw, spare=()) -> list[float]:
    """Move ``p`` until at most two entries are fractional, keeping the sums of
    p and of p * size; the entries ``spare`` stay as they are.  ``draw``:
    uniform numbers in [0, 1)."""
    p = list(p)
    hold: list[int] = []
    for k in range(len(p)):
        if 0 < p[k] < 1 and k not in spare:
            hold.append(k)
        while len(hold) == 3:
            a, b, c = (sizes[i] for i in hold)
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
            scale = max(map(abs, u))
            u = [x / scale for x in u]
            up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(hold, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(hold, u, strict=True) if x)
            step = up if draw() * (up + down) < down else -down
            for i, x in zip(hold, u, strict=True):
                p[i] = min(1.0, max(0.0, p[i] + step * x))
                if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                    p[i] = float(round(p[i]))
            hold = [i for i in hold if 0 < p[i] < 1]
    return p


def landing(sizes: list[int], p: list[float]) -> list[float]:
    """Settle the last fractional entries (some LANDING + 2): the 0/1 choice nearest in words, then in documents."""
    import numpy as np

    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    words, docs = sum(sizes[i] * p[i] for i in rest), sum(p[i] for i in rest)
    total, count = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for i in rest:  # sums of all subsets, bit k of the place for the k-th entry
        total, count = np.concatenate([total, total + sizes[i]]), np.concatenate([count, count + 1])
    best = int(np.lexsort((np.arange(len(total)), np.abs(count - docs), np.abs(total - words)))[0])
    out = list(p)
    for k, i in enumerate(rest):
        out[i] = float(best >> k & 1)
    return out


def _fly(seed: int, last: bool):
    def run(chunk):
        import random
        import zlib

        import pyarrow as pa

        rows = list(zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "size", "src", "times", "p", "copy")), strict=True))
        rows.sort(key=lambda r: (zlib.crc32(repr((seed, r[0], r[1], r[5])).encode()), r[0] is None, r[0] or 0, r[1], r[5]))
        sizes, p = [r[1] for r in rows], [r[4] for r in rows]
        spare = set(sorted((k for k, x in enumerate(p) if 0 < x < 1), key=lambda k: -sizes[k])[:LANDING]) if last else ()
        p = flight(sizes, p, random.Random(repr((seed, rows[0][2], rows[0][:2], rows[0][5]))).random, spare)
        if last:
            p = landing(sizes, p)
        ids, sizes, srcs, times, _, copies = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip((ids, sizes, srcs, times, p, copies), kinds, strict=True)], names=["doc_id", "size", "src", "times", "p", "copy"])

    return run


def decide(documents: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and times (how often the row is taken).

    Null and empty texts have size 0; a null source is a source of its own; a
    null doc_id and repeated rows are rows like others; an empty table gives an
    empty result.  Only one row per source comes to the driver.  doc_id is cast
    to a whole number: a text that is none is an error.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    # equal rows as one with their number, then in blocks of CHUNK, then one by one again: no group of them stays in one task
    equal = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = park(equal.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("block")), "mix-sizes")
    inside = F.least(F.lit(CHUNK), F.col("n") - F.col("block") * CHUNK)
    found = {r[0]: r[1:] for r in sized.groupBy("source").agg(F.sum(F.col("size") * inside), F.sum(inside)).collect()}
    order = sorted(x for x in found if x is not None) + [None] * (None in found)
    goal = targets([(x, found[x][0]) for x in order], weights, share, most)
    rows = []
    for i, (x, t) in enumerate(zip(order, goal, strict=True)):
        rate = t / found[x][0] if found[x][0] else Fraction(0)
        times = int(rate)
        rows.append((x, i, found[x][0], float(t), times, float(rate - times), max(1, -(-found[x][1] // CHUNK))))
    info = spark.createDataFrame(rows, "of_source string, src int, source_size bigint, target double, times int, p double, chunks bigint")
    start = sized.join(info, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "src", "times", "p", "chunks", F.explode(F.sequence(F.col("block") * CHUNK, F.col("block") * CHUNK + inside - 1)).alias("copy"))
    left, done, r = start, [], 0
    while True:
        most_chunks = max([1, *(x[6] for x in rows)])
        chunk = F.pmod(F.xxhash64(F.lit(seed + r), F.coalesce("doc_id", F.lit(-1)), "size", "copy"), F.col("chunks")).alias("chunk")
        flown = left.select("doc_id", "size", "src", "times", "p", "copy", chunk).groupBy("src", "chunk").applyInArrow(_fly(seed + r, most_chunks == 1), SCHEMA)
        flown = park(flown, "mix-flight")
        if most_chunks == 1:
            done.append(flown)
            break
        done.append(flown.where("p in (0, 1)"))
        rows = [(*x[:6], max(1, -(-2 * x[6] // CHUNK))) for x in rows]  # a chunk leaves two rows at most
        again = spark.createDataFrame([(x[1], x[6]) for x in rows], "of_src int, chunks bigint")
        left = flown.where("p > 0 and p < 1").join(again, F.col("src") == F.col("of_src")).drop("of_src")
        r += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    by = info.select(F.col("src").alias("of_src"), F.col("of_source").alias("source"), "source_size", "target")
    out = out.join(by, F.col("src") == F.col("of_src"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("times") + F.col("p").cast("int")).alias("times"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: with all their columns, a row once
    for each time that it is taken.  Rows with equal doc_id, source and number
    of words share what was decided for them.

    A null source is a source, the last one.  Rows without words (null and empty
    texts) are taken like others of their source, whose total they don't change;
    of a source without words nothing is taken.  A null doc_id is like any other
    value, ties are settled by the rows' content, columns may have any name, an
    empty table stays empty.
    """
    from pyspark.sql import Window

    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.coalesce("source", F.lit("\0")), size)
    decided = decide(documents, **options)
    own = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("source", F.lit("\0")), "size")
    times = park(decided.groupBy(own.alias("of_key")).agg(F.count(F.lit(1)).alias("rows"), F.sum("times").cast("int").alias("times")), "mix-times")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    docs = documents.select(row.alias("row"), key.alias("key"))
    # most rows have a key of their own: only these go by the shuffle
    taken = docs.join(times.where("rows = 1 and times > 0"), F.col("key") == F.col("of_key")).select("row", "times")
    several = times.where("rows > 1 and times > 0")
    n = several.count()
    if n:
        # the rows of a key by their content, equal ones as one with their number; the first of them in that order
        # are taken once more than the others
        few = F.broadcast(several) if n <= BROADCAST_KEYS else several
        equal = docs.join(few, F.col("key") == F.col("of_key")).groupBy("key", "rows", "times", F.to_json("row").alias("content")).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("key").orderBy("content").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("times") % F.col("rows") - before))
        equal = equal.select("row", (F.col("n") * F.floor(F.col("times") / F.col("rows")) + extra).cast("int").alias("times"))
        taken = taken.unionByName(equal.where("times > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select(*[F.col("row")[c].alias(c) for c in documents.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("bigint").alias("taken"))
