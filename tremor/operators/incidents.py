"""Incidents from anomalies: bursts of a service, merged along the dependency graph; impact paths; fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.config import DETECTABLE_SIGNALS
from tremor.operators import graph
from tremor.store import park

OF_SERVICE = ("case_id", "service")
HOUR_MS = 3_600_000
TOP_SERVICES = 4
DIMENSIONS = 2 * len(DETECTABLE_SIGNALS) + TOP_SERVICES


def session_signals(anomalies: DataFrame, gap_ms: int) -> DataFrame:
    """Bursts of a service by signal: case_id, service, session, signal_type, first_ms, last_ms, anomalies and peak.

    A pause of more than ``gap_ms`` ends a burst; session names it by its
    first anomaly.  Anomalies are first counted in slices of ``gap_ms``, of
    which one never holds a pause, so that what is shuffled and walked in
    order is a row for each slice and signal, however many anomalies a service
    has; the anomalies are read once.
    Anomalies without a time are left out; those without a service belong to
    one of name null.
    """
    at, piece = F.col("timestamp_ms"), F.floor(F.col("timestamp_ms") / gap_ms).alias("piece")
    slices = anomalies.where("timestamp_ms is not null").groupBy(*OF_SERVICE, piece, "signal_type").agg(
        F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count(F.lit(1)).alias("anomalies"), F.max(F.abs("score")).alias("peak")
    )
    by = Window.partitionBy(*OF_SERVICE).orderBy("piece")  # null is a service, too
    whole, earlier = by.rangeBetween(0, 0), by.rangeBetween(Window.unboundedPreceding, -1)
    pause = F.min("first_ms").over(whole) - F.max("last_ms").over(earlier)
    opened = slices.withColumn("opened", F.when(F.coalesce(pause > gap_ms, F.lit(True)), F.min("first_ms").over(whole)))
    named = opened.withColumn("start_ms", F.max("opened").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    session = F.concat_ws("|", F.coalesce("case_id", F.lit("")), F.coalesce("service", F.lit("")), F.col("start_ms").cast("string"))
    return named.withColumn("session", session).groupBy(*OF_SERVICE, "session", "signal_type").agg(
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("anomalies").alias("anomalies"), F.max("peak").alias("peak")
    )


def sessions(by_signal: DataFrame) -> DataFrame:
    """case_id, service, session, start_ms, end_ms, anomalies and peak of each burst."""
    return by_signal.groupBy(*OF_SERVICE, "session").agg(F.min("first_ms").alias("start_ms"), F.max("last_ms").alias("end_ms"), F.sum("anomalies").alias("anomalies"), F.max("peak").alias("peak"))


def _on_edges(bursts: DataFrame, edges: DataFrame, both: bool) -> DataFrame:
    """Every burst once for each edge that its service is on; ``callee``: whether it is the edge's target."""
    own = edges.select("source", "target").where("source <> target").distinct()
    if both:
        own = own.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    own = park(own, "edges")  # read once for each end
    ends = [own.select(F.col(c).alias("service"), F.struct("source", "target").alias("edge"), F.lit(c == "target").alias("callee")) for c in ("source", "target")]
    return bursts.join(ends[0].unionByName(ends[1]), "service")


def overlaps(bursts: DataFrame, edges: DataFrame, slack_ms: int = 0) -> DataFrame:
    """Links u, v of bursts of neighbours that overlap in time, or are at most ``slack_ms`` apart (the sessions' gap at most).

    Bursts of one service never overlap, so that of all earlier bursts on an
    edge only the one that ends last can reach a burst's beginning without
    being linked to it already: one pass in order, and no pairs of bursts.
    """
    by = Window.partitionBy("case_id", "edge").orderBy("start_ms", "session").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct("end_ms", "session")).over(by)
    rows = _on_edges(bursts, edges, both=True).withColumn("before", before)
    return rows.where(F.col("start_ms") <= F.col("before.end_ms") + slack_ms).select(F.col("session").alias("u"), F.col("before.session").alias("v"))


def members(bursts: DataFrame, edges: DataFrame, slack_ms: int = 0) -> DataFrame:
    """The bursts with incident_id: the smallest session that they are joined to by overlaps along dependencies."""
    found = graph.components(overlaps(bursts, edges, slack_ms)).withColumnRenamed("node", "session")
    return bursts.join(found, "session", "left").withColumn("incident_id", F.coalesce("component", "session")).drop("component")


def incident_sessions(bursts: DataFrame) -> DataFrame:
    """One row for each incident of ``bursts`` (as from ``members``)."""
    first = F.min(F.struct("start_ms", "service"))
    return bursts.groupBy("case_id", "incident_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), first["service"].alias("first_service"), F.array_sort(F.collect_set("service")).alias("services"),
        F.count(F.lit(1)).alias("sessions"), F.sum("anomalies").alias("anomalies"), F.max("peak").alias("peak_score"),
    )


def hops(bursts: DataFrame, edges: DataFrame, lag_ms: int) -> DataFrame:
    """Directed links u -> v: a caller's burst v that begins while, or at most ``lag_ms`` after, the callee's burst u goes on.

    With a lag of the sessions' gap at most, a burst has one such cause on an
    edge, the callee's last burst before it: an as-of lookup in one pass.
    """
    by = Window.partitionBy("case_id", "edge").orderBy("start_ms", F.desc("callee"), "session").rowsBetween(Window.unboundedPreceding, -1)
    cause = F.last(F.when(F.col("callee"), F.struct("end_ms", "session")), ignorenulls=True).over(by)
    rows = _on_edges(bursts, edges, both=False).withColumn("cause", cause).where("not callee")
    return rows.where(F.col("start_ms") <= F.col("cause.end_ms") + lag_ms).select(F.col("cause.session").alias("u"), F.col("session").alias("v"))


def impact_paths(bursts: DataFrame, edges: DataFrame, origins: DataFrame, lag_ms: int) -> DataFrame:
    """Services that a failure of the origins (case_id, service) can have reached: case_id, origin, service, arrival_ms, hops, path.

    A path goes from a service to one that depends on it, and no hop goes back
    in time: each burst begins during the one before it or soon after.  A
    service's arrival is the earliest burst that any such path leads to; hops
    and path are the shortest to that burst, the alphabetically first of equal
    ones.  The frontier carries times in its bursts; every burst is reached
    once for each origin, so that rings end.
    """
    step = park(hops(bursts, edges, lag_ms), "hops")
    known = park(bursts.select("case_id", "session", "service", "start_ms"), "bursts")
    start = origins.select("case_id", "service").where("service is not null").distinct()
    near = known.join(start, ["case_id", "service"]).select("case_id", F.col("service").alias("origin"), "session", "service", "start_ms", F.lit(0).alias("hops"), F.col("service").alias("path"))
    near = found = park(near, "reached")
    far = 0
    while not near.isEmpty():
        far += 1
        onward = near.select("case_id", "origin", F.col("session").alias("u"), "path").join(step, "u").select("case_id", "origin", F.col("v").alias("session"), "path")
        onward = onward.join(known, ["case_id", "session"]).groupBy("case_id", "origin", "session", "service", "start_ms").agg(F.min("path").alias("path"))
        onward = onward.join(found, ["case_id", "origin", "session"], "left_anti").withColumn("hops", F.lit(far))
        near = park(onward.select(*found.columns[:-1], F.concat_ws(" > ", "path", "service").alias("path")), "reached")
        found = found.unionByName(near)
    first = found.where("service <> origin").groupBy("case_id", "origin", "service").agg(F.min(F.struct("start_ms", "hops", "path")).alias("x"))
    return first.select("case_id", "origin", "service", F.col("x.start_ms").alias("arrival_ms"), F.col("x.hops").alias("hops"), F.col("x.path").alias("path"))


def fingerprints(bursts: DataFrame, by_signal: DataFrame) -> DataFrame:
    """case_id, incident_id, start_ms, anomalies and v, a vector that does not depend on service names, so that incidents
    of different systems compare: for each signal the logarithm of its peak and the promptness of its first anomaly
    (1 at the incident's beginning, 1/2 after an hour), then the logarithms of the highest peaks of services."""
    whole = bursts.groupBy("case_id", "incident_id").agg(F.min("start_ms").alias("start_ms"), F.sum("anomalies").alias("anomalies"))
    rows = by_signal.select("session", "service", "signal_type", "first_ms", "peak").join(bursts.select("session", "incident_id"), "session")
    signals = rows.groupBy("incident_id", "signal_type").agg(F.max("peak").alias("peak"), F.min("first_ms").alias("first_ms"))
    values = F.map_from_entries(F.collect_list(F.struct("signal_type", F.struct(F.log1p("peak").alias("peak"), "first_ms"))))
    services = rows.groupBy("incident_id", "service").agg(F.max("peak").alias("peak"))
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("peak"), "service"))
    highest = services.withColumn("place", rank).where(F.col("place") <= TOP_SERVICES).groupBy("incident_id").agg(F.array_sort(F.collect_list(F.log1p("peak")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("high"))
    found = whole.join(signals.where("signal_type is not null").groupBy("incident_id").agg(values.alias("m")), "incident_id").join(highest, "incident_id")

    def of_signal(name: str) -> list[Column]:
        x = F.try_element_at("m", F.lit(name))
        prompt = 1 / (1 + (x["first_ms"] - F.col("start_ms")) / HOUR_MS)
        return [F.coalesce(x["peak"], F.lit(0.0)), F.coalesce(prompt, F.lit(0.0))]

    parts = [y for name in DETECTABLE_SIGNALS for y in of_signal(name)]
    parts += [F.coalesce(F.try_element_at("high", F.lit(k + 1)), F.lit(0.0)) for k in range(TOP_SERVICES)]
    return found.select("case_id", "incident_id", "start_ms", "anomalies", F.array(*parts).alias("v"))


def main_incidents(prints: DataFrame) -> DataFrame:
    """The fingerprint of each case's incident with the most anomalies, ties by id."""
    best = prints.groupBy("case_id").agg(F.max_by("incident_id", F.struct("anomalies", "incident_id")).alias("incident_id"))
    return prints.join(best, ["case_id", "incident_id"], "left_semi")
