import random
import re
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from tremor.llm import mixing as M


def test_targets_by_hand():
    assert M.targets([("a", 10), ("b", 100), (None, 100)]) == [20, Fraction(295) * Fraction(2, 3), Fraction(295) / 3]
    assert M.targets([("a", 0), ("b", 8)]) == [0, 12]
    assert M.targets([]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=80), st.floats(0.05, 0.95), st.integers(0, 99))
def test_flight_keeps_totals(sizes, p, seed):
    got = M.flight(sizes, [p] * len(sizes), random.Random(seed).random)
    assert sum(0 < x < 1 for x in got) <= 2
    assert abs(sum(got) - p * len(sizes)) < 1e-6
    assert abs(sum(x * s for x, s in zip(got, sizes)) - p * sum(sizes)) < 1e-4
    landed = M.landing(sizes, got)
    assert set(landed) <= {0.0, 1.0}


def test_mix(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 16)  # several rounds of flight
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.decide(docs).collect()
    assert sorted(rows) == sorted(M.decide(docs).collect())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    for (_, source_size, target), own in by.items():
        assert sum(r.size for r in own) == source_size
        assert all(0 <= r.times <= 2 for r in own)
        assert abs(sum(r.times * r.size for r in own) - target) <= (target / 100 if len(own) > 8 else min(r.size for r in own if r.size))
    taken = Counter({r.doc_id: r.times for r in rows if r.times})
    assert Counter(r.doc_id for r in M.mix(docs).collect()) == taken


def plain_targets(sizes):
    """Shares by repeated filling, with floats: each round gives what is left to the open sources by weight."""
    order = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    out, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-6 and (open_ := [x for x in order if out[x] < 2 * sizes[x] - 1e-6]):
        unit = left / sum(weight[x] for x in open_)
        for x in open_:
            given = min(unit * weight[x], 2 * sizes[x] - out[x])
            out[x] += given
            left -= given
    return out


def test_query_comes_near_every_target(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += words[d.doc_id]
    want = plain_targets(sizes)
    source = {d.doc_id: d.source for d in docs}
    got = M.op7_mixing(spark, sf).collect()
    assert len(got) == len(docs) and all(r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert abs(r.target - want[source[r.doc_id]]) < 1e-3
    for x, t in want.items():
        assert abs(taken[x] - t) <= t / 100, (x, taken[x], t)


def test_edges(spark):
    schema = "doc_id bigint, text string, source string, times int, size string"
    rows = [(1, "a b", "x", 1, "s"), (1, "a b", "x", 1, "s"), (None, None, None, 2, None), (3, "", "y", 3, ""), (4, "w " * 40_000, "y", 4, "")]
    docs = spark.createDataFrame(rows, schema)
    got = M.decide(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 0), (1, 2), (1, 2), (3, 0), (4, 40_000)]
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.times for r in got)
    empty = spark.createDataFrame([], schema)
    assert M.decide(empty).count() == 0 and M.mix(empty).count() == 0


def test_rows_without_words_go_with_their_source(spark):
    rows = [(1, "a b c d", "x"), (2, None, "x"), (3, "", "x"), (4, None, "y"), (5, " ", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(r.doc_id for r in M.mix(docs).collect())
    assert set(got) <= {1, 2, 3} and got.count(1) >= 1 and got.count(2) >= 1


def test_equal_rows_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 8)
    rows = [(None, "one two three", "a")] * 90 + [(k, "word " * (k % 7), "a" if k % 2 else "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = M.decide(docs).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, M.decide(docs.repartition(7)).collect()))
    want = M.targets([(s, sum(len(t.split()) for _, t, x in rows if x == s)) for s in "ab"])
    for s, t in zip("ab", want):
        assert abs(sum(r.times * r.size for r in got if r.source == s) - t) <= 7
    taken = M.mix(docs).collect()
    assert len(taken) == sum(r.times for r in got) and sum(r.doc_id is None for r in taken) == sum(r.times for r in got if r.doc_id is None)
