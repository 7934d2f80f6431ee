import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.operators import store

SCHEMA = "map string, vol int, cell long, value double"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(m, v, c, float(c + 100 * v)) for m in ("beta", "n") for v in range(2 if m == "beta" else 1) for c in range(40)]
    store.save_maps(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/maps", width=10)
    return f"{tmp_path}/maps", {r[:3]: r[3] for r in rows}


def values(spark, path):
    return {tuple(r)[:3]: r["value"] for r in store.read_maps(spark, path).collect()}


def test_blocks_replace_their_own_cells(spark, stored):
    path, want = stored
    assert values(spark, path) == want
    before = files(path)
    for block in ([("beta", 1, c, -1.0 * c) for c in (3, 4, 15)], [("beta", 1, 4, 7.0), ("n", 0, 39, 8.0), ("new", 0, 5, 9.0)]):
        store.upsert_stored(spark.createDataFrame(block, SCHEMA), path)
        want |= {b[:3]: b[3] for b in block}
        assert values(spark, path) == want
    after = files(path)
    touched = {"map=beta/vol=1/part=0", "map=beta/vol=1/part=1", "map=n/vol=0/part=3", "map=new/vol=0/part=0"}
    part = lambda f: os.path.relpath(os.path.dirname(f), path)
    assert {f: t for f, t in before.items() if part(f) not in touched} == {f: t for f, t in after.items() if part(f) not in touched}
    assert not set(before) & {f for f in after if part(f) in touched}
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_a_block_may_be_computed_from_the_table(spark, stored):
    path, want = stored
    store.upsert_stored(store.read_maps(spark, path).where("map = 'n'").withColumn("value", F.col("value") + 1), path)
    assert values(spark, path) == {k: v + (k[0] == "n") for k, v in want.items()}


def test_a_failed_block_changes_nothing(spark, stored):
    path, want = stored
    before = files(path)
    with pytest.raises(ValueError, match="more than one value"):
        store.upsert_stored(spark.createDataFrame([("n", 0, 1, 1.0), ("n", 0, 1, 2.0)], SCHEMA), path)
    lost = spark.createDataFrame([("n", 0, 1, 1.0)], SCHEMA).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.upsert_stored(lost, path)
    assert files(path) == before and values(spark, path) == want
    store.upsert_stored(spark.createDataFrame([], SCHEMA), path)
    assert files(path) == before


@pytest.fixture
def forms(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(b, c, 5, 4, rng.normal(size=4).tolist(), rng.normal(size=2).tolist(), float(b)) for b in range(6) for c in range(300) if (b + c) % 7]
    given = spark.createDataFrame(rows, "batch long, cell long, n_rows long, n long, xtx array<double>, xty array<double>, yty double")
    table = f"forms_{tmp_path.name}".replace("-", "_").lower()
    yield store.save_forms(given, table, f"{tmp_path}/forms", 4), rows, table, tmp_path
    spark.sql(f"DROP TABLE {table}")


def added(rows, cells):
    out = {}
    for _, c, n_rows, n, xtx, xty, yty in rows:
        if c in cells:
            one = out.setdefault(c, [0, 0, np.zeros(4), np.zeros(2), 0.0])
            out[c] = [one[0] + n_rows, one[1] + n, one[2] + xtx, one[3] + xty, one[4] + yty]
    return out


def equal(found, want):
    got = {r["cell"]: r for r in found.collect()}
    assert got.keys() == want.keys()
    for c, (n_rows, n, xtx, xty, yty) in want.items():
        assert (got[c]["n_rows"], got[c]["n"], got[c]["yty"]) == (n_rows, n, yty)
        np.testing.assert_allclose(got[c]["xtx"], xtx)
        np.testing.assert_allclose(got[c]["xty"], xty)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forms_are_looked_up_without_a_shuffle(spark, forms):
    stored, rows, table, path = forms
    some = set(range(0, 300, 17)) | {9999}
    keys = store.save_keys(spark.createDataFrame([(c,) for c in some], "cell long"), f"{table}_keys", f"{path}/keys", 4)
    for auto in ("-1", str(10 << 20)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        found = store.look_up(stored, keys, 2)
        assert "Exchange" not in plan(found)
        equal(found, added(rows, some))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"DROP TABLE {table}_keys")


def test_ranges_of_cells_reach_the_scan(spark, forms):
    stored, rows, _, _ = forms
    found = store.look_up(stored, (40, 60), 2)
    told = plan(found)
    assert "Exchange" not in told and "GreaterThanOrEqual(cell,40)" in told and "LessThanOrEqual(cell,60)" in told
    equal(found, added(rows, set(range(40, 61))))


def test_narrow_ranges_do_not_multiply_with_the_cells(spark, tmp_path):
    for cells in (300, 3000):
        path = f"{tmp_path}/{cells}"
        store.save_maps(spark.range(cells).select(F.lit("n").alias("map"), F.lit(0).alias("vol"), F.col("id").alias("cell"), F.col("id").cast("double").alias("value")), path, width=2)
        assert len(files(path)) <= 64
        before = files(path)
        store.upsert_stored(spark.createDataFrame([("n", 0, 1, -1.0)], SCHEMA), path)
        assert len(set(before) - set(files(path))) == 1 and len(files(path)) == len(before)
        assert values(spark, path) == {("n", 0, c): -1.0 if c == 1 else float(c) for c in range(cells)}
