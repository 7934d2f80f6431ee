import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.llm import negatives, registry, topk
from gridols.llm.common import materialize

SF = "/root/testdata/sf0.001"


def brute(rows, asks, positives=5, k=3):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, q, own in ok:
        if asks(i):
            scored = sorted((-dot(q, v), j, label) for j, v, label in ok if j != i)
            for p, j, _ in [s for s in scored if s[2] == own][:positives]:
                fit = [(n, m) for n, m, label in scored if label != own and 50 * -p <= 100 * -n <= 95 * -p][:k]
                out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 3] + rng.normal(size=6)).round(1)], i % 4) for i in range(260)]
    rows += [(i, rows[0][1], i % 4) for i in range(300, 330)]  # equal vectors in all labels
    rows += [(0, rows[7][1], 3), (0, rows[8][1], 0), (3, rows[3][1], 3)]  # repeated ids
    rows += [(400, None, 1), (402, [1.0, None], 1), (404, [float("nan")] * 6, 2), (406, [float("inf")] * 6, 2), (408, [1.0, 2.0], 1), (410, [], 1), (412, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, block int, pack string, n int")
    want = brute(rows, lambda i: i % 2 == 0)
    assert len(want) > 500
    for how in ({"block": 16, "pack": 7}, {"block": 1, "pack": 1000}, {}):
        assert ids(negatives.mine(df, F.col("vec_id") % 2 == 0, **how)) == want


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(c.sql(registry.SQL["op11_hard_negatives"]).fetchall())
    got = ids(registry.QUERIES["op11_hard_negatives"](spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    assert got == want and want


def test_one_label_has_most_rows_and_small_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=70)], 0 if i % 9 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(negatives, "CELL", 8)
    assert ids(negatives.mine(df, F.col("vec_id") % 5 == 0, block=32, pack=4)) == brute(rows, lambda i: i % 5 == 0)


def test_intervals_hold_every_score_and_leave_few_pairs():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-700, 700, (500, 64)), rng.integers(-700, 700, (40, 64))
    v[0], q[0] = 0, 0
    low, high = negatives.intervals(q, *negatives.coded(v, 64), 64)
    score = q @ v.T
    assert (low <= score).all() and (score <= high).all()
    kth = np.partition(low, -5, axis=1)[:, -5]
    assert (high >= kth[:, None])[1:].mean() < 0.1


def test_large_scores_are_refused(spark):
    df = spark.createDataFrame([(0, [3e7, 1.0], 1), (1, [3e7, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="2\\*\\*53"):
        negatives.mine(df, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="2\\*\\*53"):
        negatives.mine(spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1)], df.schema), F.col("vec_id") == 0).collect()


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1)], schema), F.lit(True)).count() == 0
    alone = negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1), (3, [0.75], 2)], schema), F.lit(True))
    assert ids(alone.select("anchor_id", "positive_id", "negative_id")) == [(1, 2, 3), (2, 1, 3)]


def test_no_join_passes_through_the_driver(spark):
    """A table of few bytes is dealt out in copies for the grid: Spark would broadcast them, whatever they come to."""
    rows = [(i, [float(i % 5), float(i % 3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blocks, packs = negatives.make_blocks(negatives.prepared(df, F.col("vec_id") % 2 == 0, 256.0), 64, 8), negatives.make_packs(negatives.prepared(df, F.col("vec_id") % 2 == 0, 256.0), 2, 4)
    _, _, grid = topk.plan(df, F.col("vec_id") % 2 == 0, 5, 256.0, 8, 4, 4)
    plans = [negatives.on_grid(materialize(blocks, "b"), materialize(packs, "p"), 2, 2, same) for same in (True, False)] + [negatives.mine(df, F.col("vec_id") % 2 == 0), grid]
    for plan in plans:
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in shown and "Broadcast" not in shown
