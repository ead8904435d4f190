import duckdb
import pytest
from tremor.llm import decontaminate as D

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves Boston at noon and runs 60 miles per hour for 3 hours before it stops, how far did it go?"


def test_whole_items_are_found(spark):
    """Brute force: every document that holds an item's text is found, and every find shares eight words in a row."""
    words = r"[^\p{L}\p{N}]+"
    want = duckdb.sql(f"""select d.doc_id, b.item_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b
      where contains(regexp_replace(lower(d.text), '{words}', ' ', 'g'), trim(regexp_replace(lower(b.text), '{words}', ' ', 'g')))""").fetchall()
    got = {(r.doc_id, r.item_id) for r in D.op5_decontaminate(spark, SF).collect()}
    assert got and set(want) <= got
    assert len(got) <= 1.2 * len(want)


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_templates_and_edges(spark, broadcast):
    docs = spark.createDataFrame(
        [
            (1, "Intro words here. " + ITEM + " The end.", "x"),
            (2, "So: " + ITEM.replace("60", "75").replace("Boston", "Denver").replace("3 hours", "4 hours"), "x"),
            (3, "A short walk in the park is good for all of us, they say, and it costs nothing at all.", "x"),
            (4, ITEM.replace("60 miles", "60 bananas").replace("train", "dog").replace("stops", "sleeps").replace("runs", "eats").replace("hours", "cakes").replace("noon", "home"), "x"),
            (None, ITEM.upper(), "x"), (None, None, "x"), (5, "", "x"), (6, "word " * 30_000, "x"), (1, "Intro words here. " + ITEM + " The end.", "x"),
        ],
        "doc_id bigint, text string, item_id string",
    )
    bench = spark.createDataFrame([(10, ITEM, 1), (10, ITEM, 1), (11, "what is the capital", 2), (12, None, 3), (None, ITEM, 4)], "item_id bigint, text string, doc_id int")
    rows = D.contaminated(docs, bench, broadcast_bytes=broadcast).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 3 and set(by) == {1, 2, None}
    assert by[1].exact and not by[2].exact
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 3, 4, 5, 6]
    assert D.contaminated(docs.where("false"), bench).count() == 0
    assert D.decontaminated(docs, bench.where("false")).count() == docs.count()


def test_inconsistent_slots_are_not_a_match(spark):
    text = "first take 5 red apples and then 5 green pears and at last 5 blue plums from the box"
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text.replace("5", "9")), (2, text.replace("5 red", "9 red").replace("5 green", "8 green").replace("5 blue", "7 blue"))], "doc_id bigint, text string")
    assert [r.doc_id for r in D.contaminated(docs, bench).collect()] == [1]


def test_names_that_begin_sentences_and_items_of_placeholders(spark):
    names = "Alice has red apples. Bob has green pears. Carol wants plums."
    bench = spark.createDataFrame([(1, names), (2, "12 + 30 = 42"), (3, "Anna, Bert, Cora, Dirk, Emil, Fred, Gina, Hugo and Ida sat down")], "item_id bigint, text string")
    texts = [
        names, names.replace("Alice", "Diana").replace("Bob", "Peter").replace("Carol", "Susan"), names.replace("Alice", "Bob"), "It says 12 + 30 = 42 here", "It says 13 + 30 = 43 here",
        "Well, Anna, Bert, Cora, Dirk, Emil, Fred, Gina, Hugo and Ida sat down again", "Well, Axel, Beth, Carl, Dora, Egon, Fritz, Gerd, Hans and Ines were there again", "Alice has a dog. Bob has a cat. Carol wants plums.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in D.contaminated(docs, bench).collect()}
    assert got == {(0, 1, True), (1, 1, False), (3, 2, True), (5, 3, True), (2, 1, False)}


def test_one_name_for_two_is_no_match(spark):
    bench = spark.createDataFrame([(1, "Alice gives Bob three of the red apples and Bob gives Alice two of the pears")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Eve gives Tom three of the red apples and Tom gives Eve two of the pears"), (2, "Eve gives Tom three of the red apples and Ida gives Kim two of the pears")], "doc_id bigint, text string")
    assert [r.doc_id for r in D.contaminated(docs, bench).collect()] == [1]


NAMES = "Alice has red apples. Bob has green pears. Carol wants plums."
SUM = "Tom has 12 apples and buys 5 more."


def test_other_letter_case_and_numbers_with_separators(spark):
    bench = spark.createDataFrame([(1, NAMES), (2, SUM), (3, "A box of 1,250.5 kg costs 3.75 dollars, so how much is left of 10,000 dollars?")], "item_id bigint, text string")
    texts = [
        NAMES.lower(), NAMES.upper(), SUM.lower(), "Before. " + SUM.upper() + " After", "Tom has 1,200 apples and buys 5.5 more.", "Ann has 1200 apples and buys 7 more.",
        "a box of 1250.5 kg costs 3.75 dollars, so how much is left of 10000 dollars?", "A box of 9.5 kg costs 1,000,000 dollars, so how much is left of 7 dollars?", NAMES.lower().replace("red", "old").replace("green", "new").replace("wants", "sells"),
        "tom had 12 apples and sold 5 more.", "Numbers 1,2,3,4,5 and 1.2.3 are here.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in D.contaminated(docs, bench).collect()}
    assert got == {(0, 1, True), (1, 1, True), (2, 2, True), (3, 2, True), (4, 2, False), (5, 2, False), (6, 3, True), (7, 3, False)}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    for table, df in (("documents", docs), ("benchmark", bench)):
        con.executemany(f"insert into {table} values (?, ?)", [tuple(r) for r in df.collect()])
    assert {(a, b, c) for a, b, c in con.sql(f"select doc_id, item_id, exact from ({D.ORACLE}) x").fetchall()} == got


def test_keys_of_documents_are_those_of_the_benchmark(spark):
    """Hashes and windows that are worked out in one go against the plain ones, of texts of every length."""
    from pyspark.sql import functions as F
    from tremor.llm import decontaminate as D

    texts = ["", None, "one", "Tom has 1,200 apples, 5.5 kg of Pears and 3 KG; ISO 9 days", " ,1,2,3.4. a.5 6,b ", "Éa ÉA éa İx ǅ ǆ 中文 ٣ x²", "1 2 3 4 5 6 7 8 9 km km"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").select("k", D._raw(F.col("text")).alias("raw"))
    df = df.withColumn("low", D._lower(F.col("raw"))).withColumn("h1", D._hashes(F.col("low")))
    df = df.withColumns({"h0": D._canonical_hashes("raw", "low", "h1"), "want": D._hashes(D._canonical(F.col("raw")))})
    for size in (1, 3, 8):
        for literal in (False, True):
            of = f"h{int(literal)}"
            df = df.withColumns({f"w{size}{of}": D._windows(F.lit(size), F.col(of), literal), f"p{size}{of}": D._placed(size, of, literal)})
    for r in df.collect():
        assert r.h0 == r.want
        for c in [c for c in df.columns if c[0] == "w" and c != "want"]:
            assert [x.key for x in r["p" + c[1:]]] == r[c] and [x.place for x in r["p" + c[1:]]] == list(range(len(r[c])))


def test_windows_that_become_rows(spark):
    from pyspark.sql import functions as F
    from tremor.llm import decontaminate as D

    keys = [0, -1, 1 << 62, -(1 << 63), 131071, 131072, 32768, 98303]
    bits = D._bits(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    tried = spark.range(-200, 140000).select("id", F.array(F.struct(F.lit(0).alias("place"), F.col("id").alias("key"))).alias("w"))
    kept = {r.id for r in tried.where(F.size(D._maybe(F.col("w"), bits)) == 1).collect()}
    low = {k % 131072 for k in keys}
    assert kept == {i for i in range(-200, 140000) if i % 131072 in low}
