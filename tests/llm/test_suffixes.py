import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridols.llm import suffixes as sx


def brute(rows):
    docs = sorted((r[0], (r[1] or "").encode()) for r in rows if r[0] is not None)
    least = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            least.setdefault(t[i : i + 50], d)
    out = []
    for d, t in docs:  # one row a row; texts of one doc_id do not remove from each other
        cut = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                cut[i + 1 : i + 51] = True
        kept = bytes(c for c, x in zip(t, cut[1:]) if not x)
        out.append((d, len(t), int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in sx.digest(sx.deduplicate(df, **how)).collect())


def test_documents_and_odd_rows(documents, odd, none):
    for df in (documents, odd):
        assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got(none) == []


@pytest.mark.parametrize("held,piece", [(1 << 20, 1 << 19), (50, 64), (500, 200)])
def test_passages_within_texts_in_any_batches(spark, monkeypatch, held, piece):
    monkeypatch.setattr(sx, "HELD", held)
    monkeypatch.setattr(sx, "HELD_SEGMENTS", held)
    monkeypatch.setattr(sx, "PIECE", piece)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("ab é"), n))
    common = [word(n) for n in (49, 50, 51, 70, 120, 300)]
    rows = [(int(d), "".join(x for _ in range(4) for x in (word(int(rng.integers(0, 60))), common[int(rng.integers(0, 6))]))) for d in rng.permutation(60)]
    rows += [(100 + i, rows[0][1][: 200 + i]) for i in range(20)] + [(200, "ab" * 400), (201, "ab" * 300), (202, "a" * 500), (203, "a" * 60), (203, "a" * 60)]
    rows += [(5, rows[3][1][:150] + "+" * 55), (5, "-" * 110), (300, "x" * 9 + "-" * 60), (301, "+" * 60), (5, rows[3][1][:150] + "+" * 55)]  # several texts under one doc_id
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, buckets=3) == brute(rows)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 600).astype(np.uint8)
    _, place, first, n = sx.anchor_runs(data, np.ones(551, bool))
    h = [sx.gram_hashes(data)[i] for i in range(581)]
    of = np.repeat(place, n)
    assert first[0] == 0 and n.sum() == 551
    assert all(of[s] == s + int(np.argmin(h[s : s + 31])) for s in range(551))
    assert sx.gram_hashes(data[100:120])[0] == h[100]


def test_a_phrase_on_every_page_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(sx, "CROWD", 20)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    phrase, near = word(30), word(49)
    rows = [(i, word(60) + phrase + word(60) + near + word(30)) for i in range(200)] + [(300 + i, word(10) + phrase + word(30)) for i in range(9)]
    rows += [(400, rows[5][1][40:140]), (401, rows[6][1][20:125])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = df.selectExpr("doc_id", "cast(text as binary) text", "xxhash64(text) alias")
    assert sx.shared_anchors(docs, 3).where("kind = 2").count() > 0
    assert got(df, buckets=3) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 2), min_size=5, max_size=5)), min_size=1, max_size=60))
def test_deep_shallow_sorts_each_group(rows):
    group, words = np.array([g for g, _ in rows]), np.array([w for _, w in rows], np.uint64)
    order, cls = sx.deep_shallow(words, group)
    assert [(rows[k][0], rows[k][1]) for k in order] == sorted((g, w) for g, w in rows)
    rank = {x: i for i, x in enumerate(sorted({(g, *w) for g, w in rows}))}
    assert cls.tolist() == [rank[g, *w] for g, w in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=5, max_size=5), min_size=2, max_size=40))
def test_blind_tries(rows):
    words, order = np.array(rows, np.uint64), np.arange(len(rows))
    trie = sx.BlindTries(words, order, np.array([0]), np.array([len(rows)]))
    assert [rows[k] for k in order] == sorted(rows)
    for start, size, branch, parent in zip(trie.start, trie.size, trie.branch, trie.parent):
        held = [rows[k] for k in order[start : start + size]]
        alike = [len({w[c] for w in held}) == 1 for c in range(5)]
        assert (alike.index(False) if False in alike else -1) == branch
        if parent >= 0:
            a, n = trie.start[parent], trie.size[parent]
            assert a <= start and start + size <= a + n and len({w[trie.branch[parent]] for w in held}) == 1
