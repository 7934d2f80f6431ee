"""Groups over a shard's fair share leave the other shards equal."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridols.llm import sharding
from tests.llm.test_sharding import bins_of


def loads(sizes, bins, shards):
    out = [0] * shards
    for s, b in zip(sizes, bins, strict=True):
        out[b] += s
    return sorted(out, reverse=True)


@pytest.mark.parametrize("hot", [[100_000], [100_000, 40_000, 9_600], [10**7, 100_000]])
def test_hot_items_leave_the_rest_equal(hot):
    sizes = hot + [100] * 2000
    got = loads(sizes, bins_of(sizes, 24), 24)
    assert got[: len(hot)] == hot and got[len(hot)] == -(-2000 // (24 - len(hot))) * 100 and got[-1] > 0  # the least possible


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(1, 9))
def test_all_items_fit(sizes, shards):
    sizes.sort(reverse=True)
    bins = bins_of(sizes, shards)
    assert len(bins) == len(sizes) and set(bins) <= set(range(shards))


def test_hot_group(spark):
    docs = [(i, "the same text " * 20) for i in range(300)] + [(1000 + i, f"own text {i} " * 20) for i in range(900)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards=24).collect()
    load, homes = defaultdict(int), {r["shard"] for r in rows if r["doc_id"] < 1000}
    for r in rows:
        load[r["shard"]] += r["size"]
    others = [load[k] for k in range(24) if k not in homes]
    assert len(homes) == 1 and len(load) == 24 and max(others) <= 1.1 * sum(others) / 23
