"""The pipeline against brute-force versions of its stages."""

import zlib
from collections import Counter

import corpus_pipeline as P
import duckdb
import numpy as np
import pytest
from tremor.llm import mixing, quality_rules, token_output
from test_near_dedup import brute

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    # quality rules: the documents that the SQL keeps
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    clean = P.quality(spark, docs, sf).cache()
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == NAMES and set(rows) == kept and len(kept) > 0.7 * len(texts)
    for doc_id, r in rows.items():
        assert set(r.text.split("\n")) <= set(texts[doc_id].split("\n")) and r.n_chars == len(r.text)
    # near-duplicates: the smallest doc_id of each group
    left = P.near_duplicates(spark, clean, sf).cache()
    want = {c for _, _, c in brute([(i, r.text) for i, r in rows.items()], 5)}
    assert left.columns == NAMES and {r.doc_id for r in left.collect()} == want
    # decontamination: no item's text is left, and few others go
    pure = P.decontamination(spark, left, sf).cache()
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i in want if any(x in norm(rows[i].text) for x in items)}
    stays = {r.doc_id for r in pure.collect()}
    assert pure.columns == NAMES and not holds & stays and len(want - stays) <= len(holds) + 1
    # mixing: totals by source
    mixed = P.mixture(spark, pure, sf).cache()
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == NAMES and set(taken) <= stays and max(taken.values()) <= 2
    size = {i: len(rows[i].text.split()) for i in stays}
    by = {}
    for i in stays:
        by.setdefault(rows[i].source, []).append(i)
    order = sorted(by)
    goal = mixing.targets([(s, sum(size[i] for i in by[s])) for s in order])
    for s, t in zip(order, goal, strict=True):
        assert abs(sum(size[i] * taken[i] for i in by[s]) - t) <= max(size[i] for i in by[s])
    # token ids: of each copy, in doc_id order
    code = token_output.Coder("byte_bpe_50k.json").tokenizer
    at = 0
    got = sorted(P.token_ids(spark, mixed, sf).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(taken.elements())
    for r in got:
        ids = code.encode(rows[r.doc_id].text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)


def test_run_and_rerun(spark, sf):
    first = P.run(spark, sf).collect()
    assert sorted(first) == sorted(P.run(spark, sf).collect()) and len(first) > 100


def test_one_of_each_group_of_repeated_rows(spark, sf):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "a"), (5, text, "c"), (None, text[::-1], "d"), (None, text[::-1], "e"), (1, text + " more", "f"), (7, None, "g"), (7, None, "g"), (8, "", "h"), (9, "x " * 30_000, "i"), (2, text + " other tail of quite many new words " * 9, "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, group_key string")
    out = P.near_duplicates(spark, docs, sf)
    got = sorted((r.doc_id or 0, r.text and len(r.text), r.group_key) for r in out.collect())
    assert out.columns == docs.columns and out.schema["group_key"].dataType.simpleString() == "string"
    assert len([x for x in got if x[0] == 1]) == 1 and len([x for x in got if x[0] == 0]) == 1
    assert [x[0] for x in got] == [0, 1, 2, 7, 7, 8, 9]
    assert P.near_duplicates(spark, docs.where("false"), sf).count() == 0


def test_contents_of_stages_on_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeats, no rows, clashing names: what each stage leaves."""
    plain = "The river rises in the hills and runs south to the sea, past farms and old mills. " + " ".join(f"w{i}" for i in range(60))
    schema = "doc_id bigint, text string, source string, kept string, n_hit int, times int"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, plain, "a", "x", 1, 1), (2, None, None, None, None, None), (3, "", "b", "", 0, 0), (None, "y " + plain, "a", "x", 1, 1), (4, " ".join(f"z{i}" for i in range(50_000)), "a", "x", 1, 1), (5, f"Before. {item} After.", "b", "x", 1, 1), (5, f"Before. {item} After.", "b", "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    assert {2, 3}.isdisjoint(ids(P.quality(spark, docs, sf))) and {0, 1, 4} <= set(ids(P.quality(spark, docs, sf)))
    assert ids(P.near_duplicates(spark, docs, sf)) == [1, 2, 3, 4, 5]
    assert ids(P.decontamination(spark, docs, sf)) == [0, 1, 2, 3, 4]
    taken = Counter(ids(P.mixture(spark, docs, sf)))
    assert set(taken) <= {0, 1, 2, 3, 4, 5} and max(taken[x] for x in (0, 1, 4)) <= 2 and taken[5] <= 4
    assert [r.doc_id for r in P.token_ids(spark, docs, sf).orderBy("start").collect()] == [1, 2, 3, 4, 5, 5, None]
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_on_odd_rows(spark, sf, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int"
    text = "One plain sentence with quite a few ordinary words in it, and then another one follows. " * 2 + "".join(f"and w{i} " for i in range(40)) + "."
    rows = [(1, text, None, "a", None, "x", 1), (1, text, None, "a", None, "x", 1), (None, text[::-1], "en", None, 3, "x", 2), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "", 3), (4, "".join(f"z{i} " for i in range(40_000)), "en", "a", 1, "y", 4)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, sf)
    if stage is not P.token_ids:
        assert out.columns == docs.columns
        out.collect()
    else:
        assert out.count() == len(rows)
    assert stage(spark, docs.where("false"), sf).count() == 0
