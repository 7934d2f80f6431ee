"""Benchmarks of more than one pass, and items without a dense row of terms."""

import numpy as np

from gridols.llm import decontam as dc

SF = "/root/testdata/sf0.01"


def test_passes_find_what_one_pass_finds(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(11).cache()
    texts = [(r["item_id"], r["text"]) for r in items.collect()]
    docs = spark.createDataFrame([(i, "Some words before it. " + t + " And some after it.") for i, t in texts] + [(10**6 + i, f"plain text number {i}") for i in range(30)], "doc_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).collect()}
    monkeypatch.setattr(dc, "MOST_ITEMS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).collect()} == one >= {(i, i) for i, _ in texts}


def test_sparse_products_are_those_of_the_matrix():
    rng = np.random.default_rng(1)
    items = dc.Items([(i, " ".join(f"w{k}" for k in rng.integers(0, 40, n)).encode()) for i, n in enumerate((0, 1, 7, 50))])
    idf, basis, z = rng.random(len(items.terms)), rng.random((len(items.terms), 5)), rng.random((4, 5))
    m = np.array([np.bincount(s, minlength=len(idf)) for s in items.passages]) * idf
    assert [len(s) for s in items.passages] == [1, 7, 48, 48] and items.item.tolist() == [1, 2, 3, 3] and items.offset.tolist() == [0, 0, 0, 2]
    np.testing.assert_allclose(items.times(idf[:, None] * basis), m @ basis)
    np.testing.assert_allclose(idf[:, None] * items.back(z), m.T @ z)
