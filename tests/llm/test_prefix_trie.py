"""Prefix trie against a plain walk of all prefixes; its SQL is tried in test_oracles.py."""

import hashlib
import random
import zlib

import pytest
from tremor.llm import prefix_trie as P

COLUMNS = "conv_id bigint, turn bigint, role string, text string, depth string, a string, base string"


def plain(rows):
    """The rows of the query for distinct turn numbers in each conversation, from sets of prefixes in memory."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            todo += children.get(x, [])
            leaves += x not in children
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
        return leaves, saved

    for node, own_members in members.items():
        ends = sorted(c for c in own_members if len(rebuilt[c]) == len(node))
        leaves, saved = below(node)
        parent = min(members[node[:-1]]) if node else None
        yield min(own_members), len(node), parent, len(own_members), len(children.get(node, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def rows_of(seed, long=0):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(199, 210), -3, -100, -101, 5_000_000_000]:
        n = rng.choice([1, 1, 2, 3, 7, 12])
        for turn in range(n):
            rows.append((c, turn if turn else None, rng.choice(["user", None]), rng.choice(["hi", "", None, "É", "more words"])))
    for c in range(300, 303):
        rows += [(c, turn, "user", f"same {turn}" if turn < long - c % 3 else "end") for turn in range(long)]
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS)
    got = P.prefix_trie(df).drop("a", "b", "pa", "pb")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_against_plain_prefixes(spark):
    rows = [*rows_of(1), (None, 1, "user", "of no conversation")]
    assert found(spark, rows) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("piece", [8, 512])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    rows = rows_of(2, long=43)
    assert found(spark, rows) == sorted(plain(rows), key=repr)


def test_few_turns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert P.prefix_trie(empty).count() == 0
    # one short conversation whose first turns would come from an absent one: a root without text
    skipped = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    ((_, got),) = [(r.conv_id, tuple(r)) for r in P.prefix_trie(spark.createDataFrame([(skipped, 0, "user", "lost", "", "", "")], COLUMNS)).drop("a", "b", "pa", "pb").collect()]
    assert got == (skipped, 0, None, 1, 0, 1, 0, hashlib.sha256(str(skipped).encode()).hexdigest())


def test_repeated_rows_are_turns_and_ties_have_an_order(spark):
    rows = [(100, 1, "b", "x"), (100, 1, "a", "y"), (100, 1, "a", "y"), (100, None, "z", "w")]
    got = P.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in rows], COLUMNS))
    assert sorted((r.depth, r.n_convs) for r in got.collect()) == [(d, 1) for d in range(5)]
    same = [(c, *r) for c in (200, 300) for r in ((1, "b", "x"), (1, "a", "long"), (1, "a", ""))]
    got = P.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in same], COLUMNS))
    texts = [*sorted(["long", ""], key=lambda x: hashlib.sha256(f"1:a{x}".encode()).hexdigest()), "x"]  # of equal role by hash
    left = [5, 5, *[5 - sum(map(len, texts[:d])) for d in (1, 2)]]
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got.collect()) == [(d, 2, 1, left[d]) for d in range(4)]
