import random

import numpy as np
import pytest
from tremor.llm import near_dedup as N
from tremor.llm.components import components
from tremor.llm.hashing import shingles, word_hashes


def sets(text, size):
    words = (text or "").encode().lower().split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, size, percent=80):
    own = [sets(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= percent * len(own[i] | own[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(own[i]), least[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, size).collect())
    assert got == sorted(brute(rows, size))
    kept = {r.doc_id for r in N.one_of_each(docs, size).collect()}
    assert kept == {c for _, _, c in got}


def test_large_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_NODES", 0)  # texts come by the shuffle join
    draw = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = draw.choices(words, k=300)
    rows = [(i, " ".join(base)) for i in range(200, 300)]
    for i in range(300):  # near copies, most alike to one another
        other = list(base)
        for k in draw.sample(range(300), draw.randint(1, 8)):
            other[k] = draw.choice(words)
        rows.append((i + 1000, " ".join(other)))
    rows += [(i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "one"), (64, "ONE"), (65, "one"), (None, "no id at all"), (None, "No id at ALL"), (66, "no\tid at all"), (67, "x y " * 20_000), (63, "one"), (None, "alone null")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, kept string, node int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = N.near_duplicates(docs, 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute([(i, (t or "").replace("\t", " ")) for i, t in rows], 2), key=key)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in found)
    assert N.one_of_each(docs, 2).columns == docs.columns
    assert N.near_duplicates(docs.where("false"), 2).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1, i) for i in range(500, 900)] + [(7, 7), (950, 940)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    want = {i: 100 for i in range(100, 401)} | {i: 1 for i in [1, *range(500, 900)]} | {940: 940, 950: 940}
    assert got == want


def test_hashes_depend_on_words_only(monkeypatch):
    texts = [b"a bb  ccc\n\x0bdd", b"", b" ", b"a", b"bb a", b"word " * 1000 + b"end"]
    plain = list(word_hashes(texts))
    assert [len(x) for x in plain] == [len(t.split()) for t in texts]
    assert plain[0][1] == plain[4][0] and len({int(x) for x in np.concatenate(plain)}) == 6
    monkeypatch.setattr("tremor.llm.hashing.PIECE", 64)
    assert all((a == b).all() for a, b in zip(plain, word_hashes(texts), strict=True))
    assert len(shingles(plain[3], 5)) == 1 and len(shingles(plain[1], 5)) == 0


def test_pairs_among_pages_of_one_template(spark):
    draw = random.Random(5)
    rows = []
    for i in range(1000):  # 43 of 50 shingles from the template: similarity 0.754 to one another
        own = [f"u{i}x{k}" for k in range(7)]
        rows.append([f"t{k}" for k in range(43)] + own)
    for i in range(0, 300, 2):  # pairs that share two more: 0.818
        rows[i + 1][43:45] = rows[i][43:45]
    order = list(range(1000))
    draw.shuffle(order)
    docs = spark.createDataFrame([(i, " ".join(rows[i])) for i in order], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, 1).collect()}
    assert got == {i: i - i % 2 if i < 300 else i for i in range(1000)}
