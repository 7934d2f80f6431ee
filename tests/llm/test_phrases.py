import hashlib
import random
import re

import duckdb
import pytest

from gridols.llm import phrases, registry

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute(docs):
    """Rows (doc_id, words, removed, hash) with every window of every document in one dictionary."""
    least = {}
    split = [(d, words_of(t)) for d, t in docs if d is not None]
    for d, w in split:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in phrases.digest(phrases.deduplicate(df)).collect())


def corpus(seed, n=60, words=400):
    """Documents with passages of 40 to 200 words in common, in part changed, exact and near copies, and a shared phrase in many contexts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(words)}"
    passages = [[word() for _ in range(rng.choice([40, 49, 50, 51, 70, 120, 200]))] for _ in range(8)]
    phrase = [word() for _ in range(45)]
    docs = []
    for d in range(n):
        w = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            if rng.random() < 0.4:
                p = p[rng.randrange(len(p)) :]
            w += p + [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.3:
            w += [rng.choice("ab") for _ in range(3)] + phrase + [rng.choice("ab") for _ in range(4)]
        docs.append([d * 3, rng.choice([" ", "\n", " \t "]).join(w)])
    for d in range(10):  # copies, some with a word exchanged
        w = words_of(docs[d][1])
        if d % 2 and w:
            w[len(w) // 2] = "other"
        docs.append([200 + rng.randrange(50), "  ".join(w)])
    rng.shuffle(docs)
    return [tuple(d) for d in docs]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert sum(r[2] > 0 for r in want) > 10
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == want


def test_small_pieces_shards_and_stretches(spark, monkeypatch):
    docs = corpus(7, n=40)
    for name, value in {"PIECE": 700, "REACH": 30, "SHARE": 100, "STRETCH": 20}.items():
        monkeypatch.setattr(phrases, name, value)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_pieces_of_long_texts_share_words(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 300)
    text = " ".join([*(f"w{k}" for k in range(300)), "x" * 2000, *(f"v{k}" for k in range(200))]).encode()
    whole = text.split()
    seen = set()
    for held in phrases.pieces_of([(0, text)]):
        for _, before, part in held:
            w = part.split()
            assert whole[before : before + len(w)] == w
            seen |= set(range(before, before + len(w) - 49))
    assert seen == set(range(len(whole) - 49))


def test_query_equals_brute_force_on_the_given_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in registry.QUERIES["op13_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute(docs)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(c.sql(registry.SQL["op13_substring_dedup"]).fetchall())


def test_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == brute(docs)
    assert found(none) == []


def test_one_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARE", 200)
    passage = " ".join(f"p{k}" for k in range(80))
    docs = [(d, f"{'a b c ' * (d % 3)}x{d} {passage} y{d} {'z ' * (d % 5)}") for d in range(300)] + [(1000 + d, passage) for d in range(300)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_spans_and_kept_words(spark):
    common = " ".join(f"c{k}" for k in range(50))
    df = spark.createDataFrame([(1, common), (2, f"a  {common}\tb")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in phrases.deduplicate(df).collect()}
    assert [tuple(s) for s in rows[2]["spans"]] == [(1, 51)] and bytes(rows[2]["kept"]) == b"a b" and rows[2]["n_words"] == 52
    assert rows[1]["spans"] == [] and bytes(rows[1]["kept"]).decode() == common
