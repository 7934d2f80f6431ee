import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridols.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_files_hold_what_whole_texts_encode_to(spark, documents, odd, shards, tmp_path):
    for name, df in (("d", documents), ("o", odd)):
        token_files.write(df, str(tmp_path / name), PATH, shards=shards, blob_docs=7)
        got = sorted(tuple(r) for r in token_files.read_back(spark, str(tmp_path / name), with_ids=True).collect())
        assert [g[:4] for g in got] == [e[:4] for e in expected(df.collect())]
        assert [list(g[4]) for g in got] == [e[4] for e in expected(df.collect())]
    assert token_files.lookup(spark, str(tmp_path / "o"), 2) == [e[4] for e in expected(odd.collect()) if e[0] == 2]
    assert token_files.lookup(spark, str(tmp_path / "d"), -1) == []


def test_dictionary_is_trained_and_checked(spark, documents, tmp_path):
    token_files.write(documents, str(tmp_path / "d"), PATH)
    dictionary = token_files.dictionary_of(spark, str(tmp_path / "d"))
    assert len(dictionary) > 500
    blob = bytes(spark.read.parquet(str(tmp_path / "d/blobs")).first()["blob"])
    with pytest.raises(ValueError, match="dictionary"):
        token_files.open_blob(blob, b"other")


@pytest.mark.parametrize("texts", [["one document"], ["a b c d e"] * 3, ["long words of one document " * 40_000], ["x"], ["same"] * 40])
def test_every_table_with_text_has_a_dictionary(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write(df, str(tmp_path / "t"), PATH)
    assert len(token_files.dictionary_of(spark, str(tmp_path / "t"))) >= 8
    got = sorted(tuple(r) for r in token_files.read_back(spark, str(tmp_path / "t"), with_ids=True).collect())
    assert [list(g[4]) for g in got] == [e[4] for e in expected(df.collect())]


def test_a_vocabulary_that_keeps_white_space_is_given_whole_texts(spark, documents, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.encoder(PATH).by_words and not token_files.encoder(path).by_words
    t = Tokenizer.from_file(path)
    token_files.write(documents.limit(20), str(tmp_path / "w"), path)
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.read_back(spark, str(tmp_path / "w"), with_ids=True).collect()}
    assert got == {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 2] for r in documents.limit(20).collect()}


def test_other_columns_may_have_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "one text", 5, "s", "b")], "doc_id long, text string, start long, shard string, blob string")
    token_files.write(df, str(tmp_path / "c"), PATH)
    assert [tuple(r) for r in token_files.read_back(spark, str(tmp_path / "c")).collect()] == [e[:4] for e in expected(df.collect())]


def test_none(spark, none, tmp_path):
    token_files.write(none, str(tmp_path / "n"), PATH)
    assert token_files.read_back(spark, str(tmp_path / "n")).count() == 0
