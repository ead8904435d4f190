import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tremor.llm import lm_score as L
from tremor.llm.elias_fano import EliasFano, Trie


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=200), st.integers(0, 62))
def test_elias_fano_successor(values, bits):
    universe = 1 << bits
    values = np.sort(np.array([x % universe for x in values], np.uint64))
    seq = EliasFano.build(values, universe)
    keys = np.concatenate([values, np.arange(0, universe, max(1, universe // 50), dtype=np.uint64)])
    assert (seq.successor(keys) == np.searchsorted(values, keys)).all()
    assert (seq.values(np.arange(len(values))) == values).all()
    lo, hi = len(values) // 3, len(values) // 2
    assert (seq.part(lo, hi) == values[lo:hi]).all()
    assert (seq.successor(keys, lo, hi) == np.clip(np.searchsorted(values, keys), lo, hi)).all()


def test_elias_fano_is_compact():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000).astype(np.uint64))
    seq = EliasFano.build(values, 1 << 40)
    assert sum(x.nbytes for x in seq.arrays()) * 8 < len(values) * (40 - math.log2(len(values)) + 4.2)


def test_trie_searches_between_the_pointers_of_the_parent():
    trie = Trie()
    trie.add("word", 1, np.zeros(3, int), np.array([3, 9, 1 << 63], np.uint64))
    trie.add("before", 3, np.array([0, 0, 2, 2, 2]), np.array([5, 8, 1, 5, 6], np.uint64), np.array([7, 8, 9, 10, 11], np.uint16))
    trie.map()
    place = trie.find("word", np.zeros(4, int), np.array([9, 4, 1 << 63, 3], np.uint64))
    assert place.tolist() == [1, -1, 2, 0]
    at = trie.find("before", place[[0, 1, 2, 2, 3, 3]], np.array([5, 5, 5, 8, 8, 7], np.uint64))
    assert at.tolist() == [-1, -1, 3, -1, 1, -1] and trie.codes("before")[at[[2, 4]]].tolist() == [10, 8]


def brute(rows):
    def tokens(text):
        return [w for w in (text or "").encode().lower().split()] + [None]

    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    docs = [tokens(t) for _, t in rows]
    train = [d for d, h in zip(docs, held, strict=True) if not h]
    c = Counter(w for d in train for w in d)
    c2 = Counter(p for d in train for p in zip([None, *d[:-1]], d, strict=True))
    c3 = Counter(p for d in train for p in zip([None, *d], d[:-1], d[1:], strict=False))
    c1 = Counter(c) | Counter({None: len(train)})  # None as a context stands before the first word
    return held, docs, c, c1, c2, c3


def expected(rows):
    held, docs, c, c1, c2, c3 = brute(rows)
    n, v = sum(c.values()), len(c)

    def p2(b, w):
        left = 0.9 * c1[b] ** -0.1 if c1[b] else 1
        return (1 - left) * c2[b, w] / c1[b] if c2[b, w] else left * (c[w] + 0.5) / max(1, n + v)

    def p3(a, b, w):
        left = 0.75 * c2[a, b] ** -0.1 if c2[a, b] else 1
        return (1 - left) * c3[a, b, w] / c2[a, b] if c3[a, b, w] else left * p2(b, w)

    out = []
    for (doc_id, _), out_of, d in zip(rows, held, docs, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d)
        score = math.log10(p2(None, d[0])) + sum(math.log10(p3(*x)) for x in zip([None, *d], d[:-1], d[1:], strict=False))
        out.append((doc_id, out_of, len(d), sum(c[w] > 0 for w in d), n, base, score))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-8)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-3, atol=1e-2)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, sf, monkeypatch, small):
    if small:  # several blocks, shards and hot words
        monkeypatch.setattr(L, "BLOCK_TOKENS", 5000)
        monkeypatch.setattr(L, "SHARD_TOKENS", 9000)
        monkeypatch.setattr(L, "HOT", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.lm_scores(docs).collect()
    check(got, expected([(r.doc_id, r.text) for r in docs.collect()]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def test_scores_do_not_depend_on_partitions_blocks_shards_or_hot_words(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for n, block, shard, hot in ((1, 10**6, 10**7, 1000), (8, 3000, 9000, 30), (64, 2000, 20_000, 300)):
        monkeypatch.setattr(L, "BLOCK_TOKENS", block)
        monkeypatch.setattr(L, "SHARD_TOKENS", shard)
        monkeypatch.setattr(L, "HOT", hot)
        found.append(sorted((r.doc_id, r.n_known, round(r.score, 3), round(r.base_score, 6)) for r in L.lm_scores(docs.repartition(n)).collect()))
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert np.allclose([x[2:] for x in other], [x[2:] for x in found[0]], rtol=1e-5, atol=2e-3)


def test_a_copy_of_a_training_document_stands_out(spark):
    words = np.random.default_rng(2).integers(0, 3000, (60, 80))
    rows = [(k, " ".join(f"w{x}" for x in words[k])) for k in range(60)]
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2]
    copy = held[0]
    rows[copy] = (copy, next(t for k, t in rows if k not in held))
    got = {r.doc_id: r.score / r.n_tokens for r in L.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[copy] > got[k] + 1 for k in held[1:])


def test_blobs_are_bounded_by_tokens_with_more_shards_than_words(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 2)
    rows = [(k, f"a w{k} b w{k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    check(L.lm_scores(docs).collect(), expected(rows))
    flagged = docs.withColumn("held_out", L.crc_of_id() % L.MOD == L.HELD_OUT)
    plan = L.Plan(flagged)
    blobs = flagged.mapInArrow(L._occurrences(plan), "shard int, block string, payload binary")
    assert plan.shards == 100 and blobs.where("shard >= 0").count() <= 200


def test_edges(spark):
    rows = [(1, "A b a"), (1, "A b a"), (2, None), (3, ""), (None, "b\tc"), (5, "x " * 50_000), (6, "only here " * 3)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, score string")
    check(L.lm_scores(docs).collect(), expected(rows))
    assert L.lm_scores(docs.where("false")).count() == 0
    none = L.lm_scores(docs.where("pmod(crc32(string(doc_id)), 7) = 2")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in none)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        L.lm_scores(spark.createDataFrame([("x", "t")], "doc_id string, text string")).collect()


def test_a_shard_is_bounded_however_large_the_corpus_is(spark, monkeypatch):
    """Words of Zipf's law, the first with a quarter of all tokens: the fullest shard stays near its share as shards
    become many, but for the most frequent three words in a row, which meet in one shard."""
    rng = np.random.default_rng(5)
    words = np.minimum(rng.zipf(1.3, (400, 250)), 10**6)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in row)) for k, row in enumerate(words)], "doc_id bigint, text string")
    flagged = docs.withColumn("held_out", L.crc_of_id() % L.MOD == L.HELD_OUT)
    three = max(Counter(t for row in words.tolist() for t in zip(row, row[1:], row[2:], strict=False)).values())
    for size in (20_000, 4000, 1000):
        monkeypatch.setattr(L, "SHARD_TOKENS", size)
        plan = L.Plan(flagged)
        blobs = flagged.coalesce(1).mapInArrow(L._occurrences(plan), "shard int, block string, payload binary").where("shard >= 0").collect()
        tokens = Counter()
        for r in blobs:
            tokens[r["shard"]] += len(L._unpack(r["payload"])[3])
        assert sum(tokens.values()) == 400 * 251 and plan.shards == -(-400 * 251 // size)
        assert max(tokens.values()) < 1.6 * size + three, (size, max(tokens.values()), three)
        assert len(plan.pairs) > 0


def test_frequent_pairs_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = np.minimum(rng.zipf(1.5, (150, 120)), 10**4)
    rows = [(k, " ".join(f"w{x}" for x in row)) for k, row in enumerate(words)] + [(1000, "w1"), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(L, "SURVEYED", 40)
    for shard, hot in ((2000, 8), (500, 30), (10**6, 8)):
        monkeypatch.setattr(L, "SHARD_TOKENS", shard)
        monkeypatch.setattr(L, "HOT", hot)
        check(L.lm_scores(docs).collect(), expected(rows))


@pytest.mark.parametrize("shard", [4000, 10**7])
def test_a_written_model_scores_new_texts(spark, sf, monkeypatch, tmp_path, shard):
    monkeypatch.setattr(L, "SHARD_TOKENS", shard)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r for r in L.lm_scores(docs, str(tmp_path / "model")).collect()}
    for again in (docs, docs.where("doc_id % 5 = 0").repartition(3)):  # of every document by itself, whatever goes with it
        got = L.score_texts(again, str(tmp_path / "model")).collect()
        assert len(got) == again.count() and all(r.held_out for r in got)
        for r in got:
            known = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (known.n_tokens, known.n_known, known.train_tokens)
            assert np.allclose((r.base_score, r.score), (known.base_score, known.score), rtol=1e-6, atol=1e-3)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "words never seen zzz", 0), (2, "x " * 40_000, 0)], "doc_id bigint, text string, score int")
    got = L.score_texts(odd, str(tmp_path / "model")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 5, 40_001] and all(r.score <= 0 for r in got)
    assert L.score_texts(odd.where("false"), str(tmp_path / "model")).count() == 0
