import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridols.llm import decontam as dc

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    assert dc.lcs(np.array(a, int), np.array(b, int)) == plain_lcs(a, b)


def test_axes_are_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(30)]
    topics = [rng.permutation(30)[:6] for _ in range(4)]
    docs = [" ".join(vocab[j] for j in rng.choice(topics[i % 4], 40)) for i in range(60)]
    items = dc.Items([(i, " ".join(vocab[j] for j in t).encode()) for i, t in enumerate(topics)])
    idf = np.ones(len(items.terms))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) text")
    axes = dc.latent_axes(df, spark.sparkContext.broadcast(items), idf, 4, 16, 8)
    rows = [[np.bincount(s, minlength=len(idf)) for s in items.seqs]]
    for d in docs:
        t = dc.term_numbers(d.encode(), items.terms)
        rows.append([np.bincount(t[a : a + 16], minlength=len(idf)) for a in range(0, len(t) - 8, 8)])
    exact = np.linalg.svd(np.vstack(rows).astype(float), full_matrices=False)[2][:4].T
    np.testing.assert_allclose(np.linalg.norm(exact.T @ axes, ord="nuc"), 4, atol=0.05)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_finds_all_that_brute_force_finds(tables):
    documents, benchmark = tables
    items = [(r["item_id"], dc.words((r["text"] or "").encode())) for r in benchmark.collect()]
    brute, clean = set(), set()
    for r in documents.collect():
        ws = dc.words(r["text"].encode())
        joined = b" " + b" ".join(ws) + b" "
        brute |= {(r["doc_id"], i) for i, s in items if b" " + b" ".join(s) + b" " in joined}
        grams = {tuple(ws[j : j + 4]) for j in range(len(ws) - 3)}
        if not any(tuple(s[j : j + 4]) in grams for _, s in items for j in range(len(s) - 3)):
            clean.add(r["doc_id"])
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(documents, benchmark).collect()}
    assert brute and len(brute & found) >= 0.98 * len(brute)
    assert not {d for d, _ in found} & clean


def test_layout_is_that_of_each_document():
    rng = np.random.default_rng(2)
    docs = [rng.integers(-1, 20, n) for n in (0, 1, 7, 8, 16, 17, 24, 25, 90, 0, 33)]
    lay, told, vectors = dc.Layout(docs, 16, 8), np.append(np.arange(20) % 3 > 0, False), rng.random((20, 4))
    got = lay.passage_sums(lay.block_sums(told, vectors), slice(None))
    want = []
    for d, t in enumerate(docs):
        for a in range(0, max(1, len(t) - 8) if len(t) else 0, 8):
            w = t[a : a + 16]
            want.append((d, a, *vectors[w[told[w]]].sum(axis=0)))
    assert [(int(d), int(a)) for d, a in zip(lay.own, lay.start)] == [w[:2] for w in want]
    np.testing.assert_allclose(got, [w[2:] for w in want])


@pytest.mark.parametrize("size", [50, 200, 400, 2000])
def test_long_items_are_found_as_copies_and_as_paraphrases(spark, tables, size):
    """Recall against a longest common subsequence of whole item and whole document, by length of the item."""
    rng = np.random.default_rng(size)
    vocabulary = sorted({w for r in tables[0].limit(60).collect() for w in r["text"].lower().split() if w.isalpha()})
    own = lambda n: list(rng.choice(vocabulary, n))
    items = {k: own(size) for k in range(8)}
    rows, n = [], 0
    for k, ws in items.items():
        loose = [w if rng.random() > 0.12 else "zzz" for w in ws]  # a word in eight is another one
        for text in (ws, own(90) + ws + own(70), own(33) + loose + own(50), own(20) + [x for w in ws for x in ([w, "qqq"] if rng.random() < 0.1 else [w])]):
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(1000 + i, " ".join(own(300))) for i in range(60)] + [(2000 + k, " ".join(ws[: size // 3] + own(200))) for k, ws in items.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")).collect()}
    number = {w: i for i, w in enumerate(vocabulary)}
    told = {d: np.array([number.get(w, -1) for w in t.split()]) for d, t in rows}
    brute = {(d, k) for k, ws in items.items() for d, t in told.items() if dc.lcs(np.array([number[w] for w in ws]), t) >= 0.8 * size}
    assert len(brute) >= 30 and len(brute & found) >= 0.97 * len(brute) and not {d for d, _ in found - brute if d >= 1000}


def test_twenty_thousand_items_take_bounded_memory():
    rng = np.random.default_rng(1)
    made = (" ".join(f"w{x}" for x in rng.integers(0, 150_000, 40)).encode() for _ in range(20_000))
    import tracemalloc

    tracemalloc.start()
    items = dc.Items(list(enumerate(made)))
    idf = np.ones(len(items.terms))
    items.finish(idf, rng.random((len(idf), 96)).astype(np.float32), 3)
    assert tracemalloc.get_traced_memory()[1] < 700 << 20
    tracemalloc.stop()


def test_paraphrases_need_the_answer(spark, tables):
    documents, benchmark = tables
    item = next(r for r in benchmark.collect() if len(dc.words(r["text"].encode())) >= 30)
    ws = item["text"].split()
    answer = dc.Items([(0, item["text"].encode())]).last[0]
    keep = {w for w in answer}
    loose = " ".join(w for k, w in enumerate(ws) if k % 3 or set(dc.words(w.encode())) & keep)
    bare = " ".join(w for k, w in enumerate(ws) if k % 3 and not set(dc.words(w.encode())) & keep)
    extra = spark.createDataFrame([(900_001, loose), (900_002, bare), (None, item["text"]), (900_003, None), (900_004, "")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(documents.select("doc_id", "text").unionByName(extra), benchmark).collect()}
    assert (900_001, item["item_id"]) in found and (900_002, item["item_id"]) not in found
    assert not any(d in (None, 900_003, 900_004) for d, _ in found)


def test_odd_rows_and_none(spark, odd, none, tables):
    empty = spark.createDataFrame([], "item_id long, text string")
    strange = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "!!!"), (4, "the cat sat on the mat and looked at the moon for a while"), (4, "again")], "item_id long, text string")
    assert dc.matches(none, strange).count() == 0 and dc.matches(odd, empty).count() == 0 and dc.matches(none, empty).count() == 0
    assert {r["doc_id"] for r in dc.matches(odd, strange).collect()} == {1, 2}
    assert dc.remove(odd, strange).columns == odd.columns and dc.remove(odd, strange).count() == odd.count() - 3
