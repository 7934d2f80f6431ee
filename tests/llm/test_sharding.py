import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridols.llm import sharding


def plain(sizes, capacity):
    room, bins = [], []
    for s in sizes:
        fit = [(r, b) for b, r in enumerate(room) if r >= s]
        if fit:
            b = min(fit)[1]
        else:
            room.append(max(capacity, s))
            b = len(room) - 1
        room[b] -= s
        bins.append(b)
    return bins


def pairs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def bins_of(sizes, shards):
    runs = sorted(sharding.pack_into(pairs_of(sizes), shards), key=lambda r: r[0])
    return [b for _, b, n in runs for _ in range(n)]


def least_capacity(sizes, shards):
    """The largest bin, and the loads, of a plain packing: hot items apart, then a search over capacities."""
    sizes, own = sorted(sizes, reverse=True), []
    while sizes and sizes[0] * (shards - len(own)) > sum(sizes):
        own.append(sizes.pop(0))
    if not sizes:
        return own
    low, high = -(-sum(sizes) // (shards - len(own))), 2 * sum(sizes)
    fits = lambda c: max(plain(sizes, c)) < shards - len(own)
    while high - low > max(1, low >> 20):
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    out = [0] * (shards - len(own))
    for s, b in zip(sizes, plain(sizes, low if fits(low) else high), strict=True):
        out[b] += s
    return own + out


@pytest.mark.parametrize("rows", ["documents", "hot", "odd"])
def test_query_equals_brute_force(spark, documents, odd, rows):
    """Every group is packed by its size: shard loads are those of a packing of single items by a plain scan."""
    hot = spark.createDataFrame([(i, "the same text " * 20) for i in range(300)] + [(1000 + i, f"own text {i} " * (1 + i % 37)) for i in range(900)] + [(5000 + i, "") for i in range(40)], "doc_id long, text string")
    df = {"documents": documents, "hot": hot, "odd": odd}[rows]
    got, sizes, homes = sharding.shard(df, shards=24).collect(), Counter(), defaultdict(set)
    for r in df.collect():
        sizes[r["text"] or ""] += len((r["text"] or "").encode()) + 8
    total = sum(sizes.values())
    rounded = lambda s: s if s * 24 * 256 >= total or s < 8192 else -(-s // (k := 1 << s.bit_length() - 13)) * k
    load = [0] * 24
    for r in got:
        load[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values()) and len(got) == df.count()
    assert all(rounded(s) == s for s in sizes.values()) and sorted(load, reverse=True) == sorted(least_capacity(list(sizes.values()), 24) + [0] * 24, reverse=True)[:24]


def test_sizes_of_many_digits_are_classed(spark):
    df = spark.createDataFrame([(i, "x" * (20_000 + i)) for i in range(700)], "doc_id long, text string")
    load = Counter()
    for r in sharding.shard(df, shards=3, grain=1).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 25_000 and len(load) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 120))
def test_tree_packs_as_a_plain_scan_does(sizes, capacity):
    sizes.sort(reverse=True)
    runs, made = sharding.best_fit_decreasing(pairs_of(sizes), capacity)
    assert [b for _, b, n in runs for _ in range(n)] == plain(sizes, capacity) and made == max(plain(sizes, capacity), default=-1) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 9))
def test_never_more_shards_than_asked(sizes, shards):
    sizes.sort(reverse=True)
    bins = bins_of(sizes, shards)
    assert len(bins) == len(sizes) and max(bins) < shards


def test_documents(documents):
    rows = sharding.shard(documents, shards=24).collect()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[b].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values()) and set(load) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.1 * sum(load.values()) / 24


def test_odd_rows_and_none(odd, none):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 1
    assert sharding.shard(none).count() == 0
