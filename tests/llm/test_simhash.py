import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridols.llm import simhash
from gridols.llm.components import components, state_of


def plain_print(text):
    words = [w.decode("utf-8") for w in re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def union(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def expected(rows):
    prints = [(r["doc_id"], plain_print(r["text"])) for r in rows if r["doc_id"] is not None]
    links = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 4]
    top = union([a for a, _ in prints], links)
    return sorted((a, f"{x:016x}", top[a]) for a, x in prints)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="Aab Zß\n\tİ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_print(text)
    assert simhash.fingerprint(text.encode(), piece=2) == plain_print(text)


def test_hash_is_that_of_spark(spark):
    assert spark.sql("SELECT xxhash64('a bß c d')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a bß c d".encode(), 42)


def test_documents_and_odd_rows(documents, odd, none):
    for df in (documents, odd):
        assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == expected(df.collect())
    assert simhash.near_duplicates(none).count() == 0


def near_prints(n, seed):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    while len(out) < n:
        x = out[int(rng.integers(0, min(len(out), 40)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("chunk", [4096, 20, 5])
def test_crowded_buckets_lose_no_link(spark, chunk):
    fps = near_prints(400, 5)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, chunk=chunk).collect()]
    want = union(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert union(range(len(fps)), links) == want


def test_masks_cover_every_close_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & diff == 0 for m in (x % (1 << 64) for x in simhash.masks()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union(nodes, [(a, b) for a, b in links if a != b])


def test_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(200)}


def test_one_of_each_group_stays(documents, odd, none):
    for df in (documents, odd, none):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        top = {a: c for a, _, c in expected(df.collect())}
        assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if r["doc_id"] is None or top[r["doc_id"]] == r["doc_id"])


def test_ids_near_the_ends_of_the_range_and_convergence(spark):
    top = 2**63 - 1
    ids = [top, top - 1, top - 2, -(2**63), -(2**63) + 1, 5, 6]
    links = [(top, top - 1), (top - 1, top - 2), (-(2**63), top), (-(2**63) + 1, 5), (6, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: (-(2**63) if i in (top, top - 1, top - 2, -(2**63)) else -(2**63) + 1) for i in ids}


def test_the_state_of_many_links_does_not_overflow(spark):
    many = spark.range(20_000_000).select((F.col("id") + F.lit(2**62)).alias("u"), (F.lit(2**63 - 1) - F.col("id")).alias("v"))
    n, a, b = state_of(many)
    assert n == 20_000_000 and (n, a, b) == state_of(many.repartition(3)) and (a, b) != state_of(many.where("u % 1000003 <> 5"))[1:]


def test_groups_that_reach_over_batches(spark):
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fps = near_prints(120, 9)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
        links = [(r["a"], r["b"]) for r in simhash.near_links(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    assert union(range(len(fps)), links) == union(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])


def test_crowded_buckets_are_cut_by_their_free_bits(spark, monkeypatch):
    """All fingerprints share two blocks, and many share more; the links are those of all pairs."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 40, 300).astype(np.int64) << np.int64(22) >> np.int64(1)
    near = [int(base[i]) ^ sum(1 << int(b) for b in rng.choice(np.arange(22, 60), int(rng.integers(1, 6)), replace=False)) for i in rng.integers(0, 300, 300)]
    close = [int(base[0]) ^ int(x) << 30 for x in range(200)]
    fps = sorted({*map(int, base), *near, *close})
    distinct = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    of = np.array(fps, np.int64).view(np.uint64)
    want = {}
    for k in range(len(fps)):  # components over all pairs
        want[k] = k
    changed = True
    while changed:
        changed = False
        for k in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(of ^ of[k]) <= 4):
                low = min(want[k], want[int(j)])
                changed |= want[k] != low or want[int(j)] != low
                want[k] = want[int(j)] = low
    for chunk in (20, 100):
        got = {r["node"]: r["component"] for r in components(simhash.near_links(distinct, chunk=chunk)).collect()}
        assert {k: got.get(k, k) for k in want} == want
    monkeypatch.setattr(simhash, "LEVELS", 1)
    got = {r["node"]: r["component"] for r in components(simhash.near_links(distinct, chunk=20)).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_masks_of_crowded_buckets_cover_close_pairs():
    rng = np.random.default_rng(13)
    for mask in (0, (1 << 21) - 1, ((1 << 64) - 1) ^ ((1 << 13) - 1)):
        masks = [m % (1 << 64) for m in simhash.finer(mask, 6, 4)]
        assert all(m & mask == mask for m in masks)
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(200):
            differ = sum(1 << int(b) for b in rng.choice(free, 4, replace=False))
            assert any(not m & differ for m in masks)
