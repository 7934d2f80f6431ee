import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.llm import topk


def brute(rows, k, asks=lambda i: i % 2 == 0):
    """By query id the k best of all pairs of its rows with rows of other ids."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in ok if asks(i)}):
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, q in ok if n == i for j, v in ok if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # many equal vectors
    rows += [(0, rows[7][1]), (0, rows[8][1]), (2, rows[2][1]), (5, rows[9][1])]  # repeated query ids, alike and not; a repeated candidate
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (406, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score string, block int, c int")
    for how in ({"block": 8, "pivots": 5, "query_rows": 40}, {"block": 1, "pivots": 1, "query_rows": 1000}, {}):
        assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, k=5, **how).collect()) == brute(rows, 5)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, k=3, block=4).collect()) == brute(rows, 3)


def test_larger_scores_are_refused(spark):
    for big in (1e300, 1e8):
        df = spark.createDataFrame([(i, [big, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="2\\*\\*53" if big == 1e300 else "2\\*\\*63"):
            topk.top_k(df, F.col("vec_id") == 0).collect()


def test_small_cells_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 10)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 4 == 0, block=8, query_rows=7).collect()) == brute(rows, 5, lambda i: i % 4 == 0)


def test_visit_stops_when_bounds_fall_below_the_kth():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.integers(c, c + 10, (64, 4)) for c in range(0, 1000, 50)])
    ids, starts = np.arange(len(rows)), np.arange(0, len(rows) + 1, 64)
    high, low = np.maximum.reduceat(rows, starts[:-1]), np.minimum.reduceat(rows, starts[:-1])
    q = rng.integers(1, 20, (5, 4))
    found, score = topk.visit(np.arange(5) + 10_000, q, ids, rows, starts, high, low, 3)
    for i in range(5):
        assert sorted(zip(-score[i], found[i])) == sorted(zip(-(rows @ q[i]), ids))[:3]
    assert ((topk.bounds(q, high, low) >= score[:, -1:]).sum(axis=1) <= 2).all()


def test_pruning_skips_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.1]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    told = topk.pruning(df, F.col("vec_id") % 50 == 0, block=64).first()
    assert told["queries"] == 120 and told["blocks"] >= 94 and told["skipped_share"] > 0.4
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, 5, lambda i: i % 50 == 0)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], schema), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema), F.lit(True)).count() == 2
