"""Bursts, incidents, impact paths, components and the vector index, against plain versions in memory."""

import itertools
import random

import numpy as np
import pytest
from tremor.operators import graph, incidents, ivf

ANOMALY = "case_id string, service string, signal_type string, timestamp_ms bigint, score double"
EDGE = "source string, target string"
GAP = 100


def frames(spark, anomalies, edges):
    by_signal = incidents.session_signals(spark.createDataFrame(anomalies, ANOMALY), GAP)
    return by_signal, incidents.sessions(by_signal), spark.createDataFrame(edges, EDGE)


def plain_bursts(anomalies):
    """(case, service, start, end, n) by walking every series."""
    out = []
    key = lambda a: (a[0] or "", a[1] or "")
    for _, own in itertools.groupby(sorted((a for a in anomalies if a[3] is not None), key=lambda a: (*key(a), a[3])), key):
        run = []
        for a in own:
            if run and a[3] - run[-1][3] > GAP:
                out.append(run)
                run = []
            run.append(a)
        out.append(run)
    return [(r[0][0], r[0][1], r[0][3], r[-1][3], len(r)) for r in out]


def some_anomalies(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["c1", "c2"]), rng.choice("abcdef"), rng.choice(["cpu", "mem", "error"]), rng.randrange(-2000, 9000), rng.choice([3.5, -9.0, 4.0])) for _ in range(n)]


def some_edges(seed, n=6):
    rng = random.Random(seed)
    return [tuple(rng.sample("abcdef", 2)) for _ in range(n)]


def test_bursts_end_with_a_pause(spark):
    rows = [*some_anomalies(1), ("c1", None, "cpu", 5, 3.0), ("c1", None, None, 105, 3.0), ("c1", "a", "cpu", None, 3.0), (None, "a", "cpu", 0, 3.0), ("c9", "z", "cpu", 0, 3.0), ("c9", "z", "cpu", 100, 3.0), ("c9", "z", "cpu", 201, -5.0)]
    _, bursts, _ = frames(spark, rows, [])
    got = bursts.collect()
    assert sorted(((r.case_id, r.service, r.start_ms, r.end_ms, r.anomalies) for r in got), key=repr) == sorted(plain_bursts(rows), key=repr)
    assert [(r.start_ms, r.end_ms, r.peak) for r in sorted(got, key=lambda r: r.start_ms) if r.case_id == "c9"] == [(0, 100, 3.0), (201, 201, 5.0)]


def test_two_bursts_and_a_bridge(spark):
    rows = [("c", "a", "cpu", t, 4.0) for t in (0, 50, 100)] + [("c", "b", "mem", t, 9.0) for t in (80, 160, 240)] + [("c", "d", "cpu", t, 4.0) for t in (230, 260)]
    rows += [("c", "a", "cpu", 900, 4.0), ("c", "z", "cpu", 40, 4.0), ("k", "b", "cpu", 90, 4.0)]
    _, bursts, edges = frames(spark, rows, [("a", "b"), ("d", "b"), ("b", "a")])
    got = {(r.case_id, tuple(r.services), r.start_ms, r.end_ms, r.first_service, r.sessions, r.anomalies, r.peak_score) for r in incidents.incident_sessions(incidents.members(bursts, edges)).collect()}
    assert got == {("c", ("a", "b", "d"), 0, 260, "a", 3, 8, 9.0), ("c", ("a",), 900, 900, "a", 1, 1, 4.0), ("c", ("z",), 40, 40, "z", 1, 1, 4.0), ("k", ("b",), 90, 90, "b", 1, 1, 4.0)}


@pytest.mark.parametrize("seed, slack", [(2, 0), (3, 60)])
def test_incidents_against_all_pairs(spark, seed, slack):
    rows, edges = some_anomalies(seed), some_edges(seed)
    _, bursts, own = frames(spark, rows, edges)
    got = {}
    for r in incidents.members(bursts, own, slack).collect():
        got.setdefault(r.incident_id, set()).add((r.case_id, r.service, r.start_ms))
    nodes = plain_bursts(rows)
    near = {frozenset(e) for e in edges}
    parent = {n[:3]: n[:3] for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in itertools.combinations(nodes, 2):
        if u[0] == v[0] and frozenset((u[1], v[1])) in near and u[2] <= v[3] + slack and v[2] <= u[3] + slack:
            parent[root(u[:3])] = root(v[:3])
    want = {}
    for n in nodes:
        want.setdefault(root(n[:3]), set()).add(n[:3])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_impact(rows, edges, origins, lag):
    """Earliest arrivals by trying every walk that never goes back in time, shortest first."""
    nodes = plain_bursts(rows)
    out = {}
    for case, origin in origins:
        layer = {n: origin for n in nodes if n[:2] == (case, origin)}
        seen = dict(layer)
        hops = dict.fromkeys(layer, 0)
        k = 0
        while layer:
            k += 1
            onward = {}
            for u, path in layer.items():
                for v in nodes:
                    if v[0] == u[0] and (v[1], u[1]) in edges and v[1] != u[1] and u[2] <= v[2] <= u[3] + lag and v not in seen:
                        onward[v] = min(onward.get(v, path), path)
            layer = {v: f"{path} > {v[1]}" for v, path in onward.items()}
            seen |= layer
            hops |= dict.fromkeys(layer, k)
        for v, path in seen.items():
            if v[1] != origin:
                out[case, origin, v[1]] = min(out.get((case, origin, v[1]), (10**9,)), (v[2], hops[v], path))
    return {(*key, *value) for key, value in out.items()}


@pytest.mark.parametrize("seed", [4, 5])
def test_impact_against_all_walks(spark, seed):
    rows, edges = some_anomalies(seed, 400), [*some_edges(seed, 9), ("a", "a")]
    origins = [("c1", "a"), ("c2", "b"), ("c2", "c"), ("c1", "nowhere"), ("c1", None)]
    _, bursts, own = frames(spark, rows, edges)
    got = {tuple(r) for r in incidents.impact_paths(bursts, own, spark.createDataFrame(origins, "case_id string, service string"), GAP).collect()}
    assert got == plain_impact(rows, set(edges), origins[:3], GAP) and got


def test_a_late_shortcut_does_not_hide_the_way_round(spark):
    # d depends on a directly, but its burst comes too late for that; by b and c it is reached in time
    rows = [("c", "a", "cpu", 0, 4.0), ("c", "b", "cpu", 80, 4.0), ("c", "c", "cpu", 160, 4.0), ("c", "d", "cpu", 240, 4.0), ("c", "e", "cpu", -10, 4.0)]
    _, bursts, edges = frames(spark, rows, [("d", "a"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("e", "d")])
    origin = spark.createDataFrame([("c", "a")], "case_id string, service string")
    got = {r.service: (r.arrival_ms, r.hops, r.path) for r in incidents.impact_paths(bursts, edges, origin, GAP).collect()}
    assert got == {"b": (80, 1, "a > b"), "c": (160, 2, "a > b > c"), "d": (240, 3, "a > b > c > d")}  # e failed before a


def test_components_against_union_find(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (2000, 5), (5, 2000)] + [(3000, k) for k in range(3001, 3100)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    alone = {u for u, v in links if u == v} - {x for u, v in links if u != v for x in (u, v)}
    got = graph.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {(r.node, r.component) for r in got} == {(x, root(x)) for x in parent if x not in alone} and len(got) == len(parent) - len(alone)
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_fingerprints(spark):
    hour = incidents.HOUR_MS
    rows = [("c", "a", "cpu", 0, 4.0), ("c", "a", "cpu", 50, -9.0), ("c", "b", "mem", hour, 3.0)]
    by_signal = incidents.session_signals(spark.createDataFrame(rows, ANOMALY), 2 * hour)
    bursts = incidents.members(incidents.sessions(by_signal), spark.createDataFrame([("a", "b")], EDGE), 2 * hour)
    (got,) = incidents.fingerprints(bursts, by_signal).collect()
    signals = list(incidents.DETECTABLE_SIGNALS)
    want = np.zeros(incidents.DIMENSIONS)
    want[2 * signals.index("cpu")], want[2 * signals.index("cpu") + 1] = np.log(10), 1
    want[2 * signals.index("mem")], want[2 * signals.index("mem") + 1] = np.log(4), 0.5
    want[-4], want[-3] = np.log(10), np.log(4)
    assert got.anomalies == 3 and np.allclose(got.v, want)
    assert incidents.main_incidents(incidents.fingerprints(bursts, by_signal)).count() == 1


def vectors(n, seed=8):
    rng = np.random.default_rng(seed)
    heavy = rng.normal(size=12)  # a third of all rows in one cell
    centers = rng.normal(size=(15, 12))
    rows = [heavy + 0.2 * rng.normal(size=12) if k % 3 == 0 else centers[rng.integers(15)] + 0.4 * rng.normal(size=12) for k in range(n)]
    rows[5] = rows[6] = rows[7]
    rows[8] = np.zeros(12)
    return [(str(k), [float(x) for x in v]) for k, v in enumerate(rows)]


def plain_nearest(rows, wanted, k):
    x = np.array([v for _, v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    out = {}
    for i in wanted:
        near = np.round(x @ x[i], 9) + 0.0
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-near[j], rows[j][0]))[:k]
        out[rows[i][0]] = [rows[j][0] for j in order]
    return out


def test_index_is_exact_and_its_short_search_has_recall(spark):
    rows = vectors(3000)
    df = spark.createDataFrame([*rows, ("none", None)], "id string, v array<double>")
    index = ivf.build(df, cells=24)
    assert index.rows.count() == 3000
    wanted = [5, *range(0, 3000, 50)]
    want = plain_nearest(rows, wanted, 10)
    queries = df.where(f"id in ({', '.join(map(repr, map(str, wanted)))})")
    got = {}
    for r in ivf.search(index, queries, 10, probes=2).collect():
        got.setdefault(r.query_id, {})[r.place] = r.id
    assert {q: [own[p] for p in range(1, 11)] for q, own in got.items()} == want
    short = ivf.search(index, queries, 10, probes=3, exact=False).collect()
    hit = sum(r.id in want[r.query_id] for r in short)
    assert hit / sum(map(len, want.values())) >= 0.9
    plan = ivf.search(index, df.where("id = '5'"), 10, probes=2, exact=False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")


def test_index_of_few_rows(spark):
    empty = spark.createDataFrame([], "id string, v array<double>")
    assert ivf.search(ivf.build(empty, 4), empty, 3).count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, v array<double>")
    assert [(r.query_id, r.id, r.place) for r in ivf.search(ivf.build(two, 4), two, 3).orderBy("query_id").collect()] == [("a", "b", 1), ("b", "a", 1)]


def test_exact_search_in_small_pieces(spark):
    """Batches of any size, ties by id, a row's own id left out, and memory that a batch doesn't decide."""
    import tracemalloc

    import pyarrow as pa
    from tremor.operators import similar

    draw = np.random.default_rng(5)
    n, k = 6000, 3
    v = draw.integers(-1, 2, (n, 4)).astype(float)  # many ties, and zero vectors
    ids = np.arange(n)[::-1].copy()
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v.tolist())], ["id", "v"])
    few = np.arange(0, n, 5)
    tracemalloc.start()
    parts = list(similar._nearest(ids[few], similar.unit(v[few]), k)(iter([batch.slice(0, 0), batch.slice(0, 5000), batch.slice(5000)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # all pairs of the larger batch: 48 MB, twice with their order
    got = {}
    for x in parts:
        for q, i, s in zip(*(c.to_pylist() for c in x.columns), strict=True):
            got.setdefault(q, []).append((-round(s, 9), i))
    u = similar.unit(v)
    for at in few[::37]:
        near = np.round(u @ u[at], 9)
        want = sorted((-s, int(i)) for s, i in zip(near, ids, strict=True) if i != ids[at])[:k]
        assert sorted(got[ids[at]]) == want


def test_bursts_and_edges_are_worked_out_once(spark, sf):
    from pyspark.sql import functions as F
    from tremor.plans import queries as Q
    from tremor.sources.adapters import Tables

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    bursts = Q.burst_signals(Tables(spark, sf))
    assert "Aggregate" not in plan(bursts) and "Join" not in plan(bursts)  # a table that was written, not all events again
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], EDGE).groupBy("source").agg(F.max("target").alias("target"))
    assert "max(target" not in plan(incidents.overlaps(incidents.sessions(bursts), edges))


def test_last_span_of_an_id_by_time_then_service(spark):
    from tremor.operators import etl

    row = "case string, time bigint, startTimeMillis bigint, spanID string, serviceName string, parentSpanID string, duration double"
    rows = [("c", 1, 1, "p", "zz", None, 9.0), ("c", 2, None, "p", "a", None, 1.0), ("c", 2, 5, "p", "b", None, 0.0), ("c", 2, 5, "p", "a", None, 9.0), ("d", 9, 9, "p", "other", None, 1.0), ("c", 3, 3, "k", "x", "p", 1.0), ("c", 3, 3, "l", "b", "p", 1.0), (None, 1, 1, "k", "y", "p", 1.0)]
    assert {tuple(r) for r in etl.dependencies(spark.createDataFrame(rows, row)).collect()} == {("b", "x")}


def test_similar_incidents_detect_once(spark, sf, monkeypatch):
    from tremor.plans import queries as Q

    calls, found = [], Q.found
    monkeypatch.setattr(Q, "found", lambda t, **options: calls.append(t) or found(t, **options))
    assert Q.QUERIES["similar_incidents"](spark, sf).columns and len(calls) == 1


def test_bursts_read_the_anomalies_once(spark, sf):
    """All events are read for the series' figures and for the anomalies, not again for each side of a join."""
    from tremor.plans import queries as Q
    from tremor.sources.adapters import Tables

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = Q.found(Tables(spark, sf))
    bursts = plan(incidents.session_signals(found, Q.ONE_DAY_MS))
    assert bursts.count("Relation [event_id") == plan(found).count("Relation [event_id") == 2
