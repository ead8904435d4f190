"""Line dedup and quality rules on odd rows; both have SQL, tried in test_oracles.py."""

import pytest
from tremor.llm import line_dedup as L
from tremor.llm import quality_rules as Q


@pytest.mark.parametrize("broadcast", [1000, 2, 1, 0])  # 2: one key is hot and goes to all tasks, the other is joined
def test_line_dedup_edges(spark, broadcast):
    rows = [(i, f" Common LINE \nown {i}\n\nÉ\n" + ("nine\n" if i < 9 else "é"), "clash") for i in range(12)]
    rows += [(20, None, "x"), (21, "", "x"), (None, "common line", "x"), (22, "common line\ncommon line", "x"), (22, "common line\ncommon line", "x"), (23, "a\x0b\n" * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    got = {}
    for r in L.line_dedup(docs, broadcast_keys=broadcast).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert got[0] == [("own 0\n\nnine\n", 6, 2)]
    assert got[10] == [("own 10\n\né", 5, 2)]  # only A-Z is folded
    assert got[20] == got[21] == [("", 1, 0)]
    assert got[None] == [("", 1, 1)] and got[22] == [("", 2, 2)] * 2
    assert got[23] == [("a\x0b\n" * 40_000, 40_001, 0)]
    assert L.line_dedup(docs.where("false")).count() == 0


def test_crowded_filter_stays_exact(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(L.line_dedup(docs, min_docs=3).collect())
    monkeypatch.setattr(L, "LEAST_BITS", 1 << 10)
    monkeypatch.setattr(L, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(L, "SEGMENT", 64)
    assert sorted(L.line_dedup(docs, min_docs=3).collect()) == want


def test_quality_rules_edges(spark):
    prose = "One plain sentence with quite a few ordinary words in it, and then some more of them. " + " ".join(f"w{i}" for i in range(30)) + "."
    eight = " ".join("abcdefgh")
    rows = [
        (1, prose, 1), (2, None, 1), (3, "", 1), (None, prose, 1), (1, prose, 1), (4, prose + "\nAll rights reserved.\nTwice.\nTwice.", 1),
        (5, "home | news | sport | " * 10, 1), (6, "WORD!! " * 3 + " ".join(f"X{i}!!" for i in range(40)), 1), (7, f"{eight} x {eight} " + " ".join(f"y{i}" for i in range(60)), 1),
        (8, " ".join(f"v{i}" for i in range(40_000)), 1), (9, "\t\x0b \r\n", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert [i for i in got if got[i].kept] == [i for i in got if i in (1, None, 4, 7, 8)]
    assert got[4].text == prose + "\nTwice.\nTwice." and got[4].n_dup_lines == 1 and got[4].base_failed is False
    assert got[7].n_repeat_words == 16 and got[8].n_words == 40_000
    assert (got[2].n_words, got[9].n_words, got[3].base_failed) == (0, 0, True)
    assert Q.clean_documents(docs).columns == docs.columns
    assert Q.quality_rules(docs.where("false")).count() == 0


def test_lines_that_fail(spark):
    fail = [
        "Home · News · Sport", "Start | Über uns | Kontakt", "Home > Shop > Shoes", "Alle Rechte vorbehalten.", "© 2024 Tous droits réservés", "Acepta la POLÍTICA DE COOKIES.",
        "Lisez les conditions d'utilisation ici.", "The storm reached the coast on Monday ...", "Mehr lesen…", "#### $$$$ ****", "NOW!!! BUY!!!",
    ]
    stay = [
        "La col·lecció i l'il·lustre · avui.", "Either / or is a question that was asked by many people of the town / village.", "He waited for a long, long while, and then he said, in a very low voice, nothing ...",
        "« Il est venu hier », dit-elle.", "A policy of privacy.", "Dots ... in the middle of it.", "Go → there.",
    ]
    text = "\n".join(x for pair in zip([*fail, *[""] * 9], [*stay, *[""] * 13], strict=True) for x in pair)
    prose = "\n" + " ".join(f"w{i}" for i in range(400)) + "."
    docs = spark.createDataFrame([(1, text + prose), (2, "\n".join(stay) + prose), (3, "\n".join(f"Alle Rechte vorbehalten: {i} {i + 1} {i + 2} {i + 3} {i + 4}" for i in range(0, 4000, 5)) + prose)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert got[1].text == got[2].text == "\n".join(stay) + prose
    assert got[1].kept and got[2].lost_chars == 0 and not got[3].kept and not got[3].base_failed

    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, lost_chars, kept from ({Q.ORACLE})").fetchall()}
    assert want == {i: (r.lost_chars, r.kept) for i, r in got.items()}
