"""Logs that matter to an incident: message templates, and how much more often each comes after the injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.store import park

ANY = "<*>"
BLANK, BLANK_RE = " \t\n\x0b\x0c\r", r"[ \t-\r]+"
DEPTH = 2


def tokens(message: Column) -> Column:
    """Words of a message; those with a digit are variables.  A null or blank message is one empty word."""
    words = F.split(F.btrim(F.coalesce(message, F.lit("")), F.lit(BLANK)), BLANK_RE)
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), ANY).otherwise(w))


def with_template(logs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``logs`` with template, by a parse tree of fixed depth: the number of words, then the first ``depth`` of them.

    In a leaf, a place keeps the word that more than half of the leaf's
    messages have there, and is a variable (``<*>``) in messages with another
    one; a message that is alone in its leaf is its own template.  Leaves are
    counted first, so that only the words of shared ones are, on the map side;
    what comes back to the messages is one row a shared leaf, which a join
    splits if a leaf is hot.
    """
    rows = logs.withColumn("_tokens", tokens(F.col("message")))
    rows = rows.withColumn("_leaf", F.struct(F.size("_tokens").alias("n"), F.slice("_tokens", 1, depth).alias("first")))
    shared = rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    words = rows.select("_leaf", "_tokens").join(shared, "_leaf").select("_leaf", "size", F.posexplode("_tokens").alias("at", "word")).groupBy("_leaf", "size", "at", "word").agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(2 * F.col("n") > F.col("size"), F.struct("at", "word"))  # a leaf without such a word has an empty map
    constant = words.groupBy("_leaf").agg(F.map_from_entries(F.collect_list(kept)).alias("_constant"))
    rows = rows.join(constant, "_leaf", "left")
    same = F.transform("_tokens", lambda w, i: F.when(w == F.try_element_at("_constant", i), w).otherwise(ANY))
    return rows.withColumn("template", F.array_join(F.when(F.col("_constant").isNull(), F.col("_tokens")).otherwise(same), " ")).drop("_tokens", "_leaf", "_constant")


def placed(scored: DataFrame) -> DataFrame:
    """``scored`` with place, the number of the row in its case by descending score and template.

    Rows are dealt by ranges of that order and numbered within a range, on top
    of the case's rows in the ranges before, one count for each: no task holds
    all templates of a case.
    """
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.col("template"))
    rows = park(scored.repartitionByRange(n, "case_id", *order).withColumn("_range", F.spark_partition_id()), "templates")
    before = Window.partitionBy("case_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("case_id", "_range").agg(F.count(F.lit(1)).alias("n")).select("case_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("case_id", "_range").orderBy(*order))
    return rows.join(F.broadcast(counts), ["case_id", "_range"]).withColumn("place", (F.col("_before") + number).cast("int")).drop("_range", "_before")


def burst_score(after: Column, before: Column, after_ms: Column, before_ms: Column) -> Column:
    """Twice the log likelihood ratio of two Poisson rates against one, negative where the later rate is the lower one."""
    total = after + before
    expected = total * after_ms / (after_ms + before_ms)

    def part(n: Column, mean: Column) -> Column:
        return F.when((n > 0) & (mean > 0), n * F.log(n / mean)).otherwise(0.0)

    g = 2 * (part(after, expected) + part(before, total - expected))
    return F.when(after >= expected, g).otherwise(-g)


def relevant_logs(logs: DataFrame, pivots: DataFrame, before_ms: int | None = None, after_ms: int | None = None, depth: int = DEPTH) -> DataFrame:
    """case_id, template, before, after, score and place: templates of each case by how much they burst after the pivot.

    ``logs``: case_id, timestamp_ms, message; ``pivots``: case_id, pivot_ms,
    and start_ms and end_ms, the bounds of what counts; ``before_ms`` and
    ``after_ms`` narrow them.  No word list: a message is relevant because it
    came with the incident.  Rows without a time are left out.
    """
    start, end = F.col("start_ms"), F.col("end_ms")
    if before_ms is not None:
        start = F.greatest(start, F.col("pivot_ms") - before_ms)
    if after_ms is not None:
        end = F.least(end, F.col("pivot_ms") + after_ms)
    bounds = pivots.select("case_id", "pivot_ms", start.alias("start_ms"), end.alias("end_ms"))
    # one row a case: a shuffle by case would bring all logs of a case to one task
    rows = logs.select("case_id", "timestamp_ms", "message").join(F.broadcast(bounds), "case_id").where("timestamp_ms between start_ms and end_ms")
    later = F.col("timestamp_ms") >= F.col("pivot_ms")
    counts = with_template(rows, depth).groupBy("case_id", "template", "pivot_ms", "start_ms", "end_ms").agg(F.count_if(~later).alias("before"), F.count_if(later).alias("after"))
    # the bounds are inclusive: a millisecond more on the later side, and never an empty one
    score = burst_score(F.col("after"), F.col("before"), (F.col("end_ms") - F.col("pivot_ms") + 1).cast("double"), (F.col("pivot_ms") - F.col("start_ms")).cast("double"))
    scored = counts.select("case_id", "template", "before", "after", F.round(score, 9).alias("score"))
    return placed(scored)


def own_pivots(logs: DataFrame) -> DataFrame:
    """The middle of each case's own logs, for logs whose clock is not that of the ground truth."""
    rows = logs.groupBy("case_id").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))
    return rows.withColumn("pivot_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
