"""The pipeline against a plain Python version of its stages, and its behaviour on odd and empty tables."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridols.llm import decontam, langid, pieces
from tests.llm.test_langid import Plain
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import union

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    sample = {x: [r["text"] for r in rows if r["lang"] == x] for x in {r["lang"] for r in rows}}
    models = [Plain(t) for t in sample.values()]
    want = [r for r in rows if any(c.isalpha() for c in r["text"]) and min(m.bits(r["text"]) for m in models) < 8 * len(langid.prepared(r["text"]))]
    docs = stage(spark, docs, 0, columns)
    assert ids(docs) == sorted(r["doc_id"] for r in want)

    cleaned = brute_lines(want, 10, True)
    docs = stage(spark, docs, 1, columns)
    assert sorted(repr((r["doc_id"], r["text"])) for r in docs.collect()) == [repr(eval(x)[:2]) for x in sorted(cleaned, key=lambda x: repr(eval(x)[:2]))]

    top = similar_groups(docs.collect())
    docs = stage(spark, docs, 2, columns)
    assert ids(docs) == sorted(a for a, c in top.items() if a == c)

    items = [b" ".join(decontam.words(r["text"].encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    told = {r["doc_id"]: b" ".join(decontam.words(r["text"].encode())) for r in docs.collect()}
    bad = {d for d, t in told.items() if any(x in t for x in items)}
    grams = {tuple(x.split()[j : j + 4]) for x in items for j in range(len(x.split()) - 3)}
    clean = {d for d, t in told.items() if not any(tuple(t.split()[j : j + 4]) in grams for j in range(len(t.split()) - 3))}
    docs = stage(spark, docs, 3, columns)
    assert not bad & set(ids(docs)) and clean <= set(ids(docs))

    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(text)
    for r in last:
        assert p.decode(r["ids"]) == text[r["doc_id"]] and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and len(r["ids"]) == r["n_pieces"]


def similar_groups(rows):
    """By document the smallest one that it is connected to over pairs of five-word Jaccard similarity 0.8 or more."""
    words = {r["doc_id"]: r["text"].encode().lower().split() for r in rows}
    sets = {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    return union(sets, [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)])


def ids(docs):
    return sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def stage(spark, docs, k, columns):
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == columns
    return out.cache()


def best_score(model, text):
    """The best path's score, place by place over the whole text."""
    s = (" " + text.replace("▁", pieces.LITERAL)).replace(" ", "▁") if text else ""
    best = [0.0] + [float("-inf")] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + model.longest) + 1):
            k = model.id_of.get(s[i:j])
            gain = model.scores[k] if k is not None else model.fallback if j == i + 1 else None
            if gain is not None and best[i] + gain > best[j]:
                best[j] = best[i] + gain
    return best[-1]


def test_run_equals_its_stages(spark):
    """All rows of the run are those of its stages one after the other, each on what the one before returned; the best paths are the best."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    rows = got.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want.collect())) and {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text) > 100
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        if len(text[r["doc_id"]]) < 4000:
            assert r["score"] == pytest.approx(best_score(model, text[r["doc_id"]]))
            assert all(s <= r["score"] for s in r["next_scores"])


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_none(spark, odd, none, k):
    name, step = corpus_pipeline.STAGES[k]
    out = step(spark, odd, SF)
    if k < 4:
        assert out.columns == odd.columns
    kept = defaultdict(int)
    for r in out.collect():
        kept[r["doc_id"]] += 1
    assert None in kept  # a row without an id is never taken for another's copy
    assert step(spark, none, SF).count() == 0
    assert step(spark, odd.withColumn("text", F.lit(None).cast("string")), SF).count() >= 1 - (k == 0) * 1
