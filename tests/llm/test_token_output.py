import zlib

import numpy as np
import pytest
from tremor.llm import token_output as T

EDGES = ["a  b", "a \n b", " x", "x ", "a\n \nb", "\n\n a", "a \n###", "\n###", "it's  we'll", "a\n ", "", "a\tb \t c", "word### word", "Été! 12 3,4", "a  b　c", "hello <|endoftext|> world", "a\n\n\nb", "a.\nB,\tc\n", "a\t\nb", "\nA", " \t, b", "x\ue000 y", "end.\n"]


def plain(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_chunks_match_whole_texts():
    code = T.Coder("byte_bpe_50k.json")
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(x, code.dtype).tolist() for x in code.encode(EDGES)]
        assert got == plain(EDGES)


@pytest.mark.parametrize("cached", [40, 500_000])
def test_chunks_match_whole_texts_of_any_pieces(monkeypatch, cached):
    monkeypatch.setattr(T, "CACHED_CHUNKS", cached)
    monkeypatch.setattr(T, "GROUP_CHARS", 2000)
    code, draw = T.Coder("byte_bpe_50k.json"), np.random.default_rng(1)
    pieces = ["a", "B", "the", "é", "1", "23", ".", ",", "'s", "'", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\n\n", "\u3000", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<", "|", "###", "中", "_", "-"]
    texts = ["".join(draw.choice(pieces, draw.integers(0, 15))) for _ in range(3000)]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == plain(texts)


def test_chunks_match_whole_texts_for_all_characters():
    """Letters of one Unicode version may be none in another."""
    code = T.Coder("byte_bpe_50k.json")
    texts = [f"a {x}. b\n{x}," for x in map(chr, range(0x110000)) if not "\ud800" <= x <= "\udfff"]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == plain(texts)


def test_query_against_whole_texts(spark, sf):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got = T.op8_token_output(spark, sf).orderBy("doc_id").collect()
    at = 0
    for (doc_id, _), ids, r in zip(rows, plain([x for _, x in rows]), got, strict=True):
        ids = np.array([*ids, T.END_ID], "<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_rows_of_one_id_and_null_ids_are_dealt(spark, tmp_path):
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    T.write_tokens(docs, str(tmp_path / "x"))
    ids = T.read_tokens(spark, str(tmp_path / "x"), ids=True).orderBy("start").collect()
    assert [r.doc_id for r in ids] == sorted((x for x, _ in rows if x is not None)) + [None] * 100
    assert sorted(map(tuple, (r.ids for r in ids))) == sorted((*x, T.END_ID) for x in plain([x for _, x in rows]))
    assert [r.start for r in ids] == np.cumsum([0, *(len(r.ids) for r in ids)])[:-1].tolist()
    images = spark.read.parquet(str(tmp_path / "x/images"))
    assert images.where("first_id = 7 and last_id = 7").select("bucket").distinct().count() > 1
    assert images.where("first_id is null").select("bucket").distinct().count() > 1
    got = T.read_documents(spark, str(tmp_path / "x"), [7, 8, 9, 10**12]).collect()
    assert sorted(r.doc_id for r in got) == [7] * 100 + [8]
    assert [tuple(r.ids) for r in got if r.doc_id == 8] == [(*plain(["text 8"])[0], T.END_ID)]


def test_an_id_that_is_no_number_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        T.write_tokens(spark.createDataFrame([("x", "t")], "doc_id string, text string"), str(tmp_path / "x"))


def test_round_trip(spark, tmp_path):
    rows = [(5, None, 1), (3, "one two", 2), (None, "null id", 3), (1, "", 4), (3, "one two", 5), (2, "long " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    T.write_tokens(docs, str(tmp_path / "x"))
    got = T.read_tokens(spark, str(tmp_path / "x")).orderBy("start").collect()
    ids = [x + [T.END_ID] for x in plain(["", "long " * 50_000, "one two", "one two", "", "null id"])]
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 5, None]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:k])) for k in range(6)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4")) for x in ids]
    assert [list(r.ids) for r in T.read_tokens(spark, str(tmp_path / "x"), ids=True).orderBy("start").collect()] == ids


def test_empty_table(spark, tmp_path):
    T.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "x"))
    assert T.read_tokens(spark, str(tmp_path / "x")).collect() == []


def test_image_checks_its_dictionary():
    image = T.pack_image([7], [b""], [0], 2, b"0" * 32)
    with pytest.raises(ValueError):
        T.Image(image, b"other")
