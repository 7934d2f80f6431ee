import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.operators import patterns
from gridols.operators.products import product_forms

XS = ["x0", "x1"]


@pytest.fixture(scope="module")
def study(spark):
    """Observations from below 0 to several bitmaps' width, with gaps that cells share in part."""
    rng = np.random.default_rng(4)
    obs = [-70000, -32768, -1, 0, 1, 5, 32768, 32769, 65536, 100000, 200001]
    design = [(o, 1.0, float(rng.normal())) for o in obs]
    gaps = [set(), {0}, {5, 1}, {-1, 100000}, set(obs[:4]), {0}]
    rows = [(o, c, 0.0 if o in gaps[c % 6] else float(rng.normal()) + 5) for o in obs for c in range(18)]
    rows += [(o, 18, 0.0) for o in obs]  # a cell without any reading
    d = spark.createDataFrame(design, "obs long, x0 double, x1 double")
    return spark.createDataFrame(rows, "obs long, cell long, y double").join(d, "obs"), d, {c: frozenset(o for o in obs if o not in gaps[c % 6]) for c in range(18)}


def ids_of(sets):
    seen = {}
    return {c: seen.setdefault(s, len(seen) + 1) for c, s in sorted(sets.items())}


def test_patterns_are_sets_of_observations(spark, study):
    rows, _, sets = study
    twice = rows.unionByName(rows.where("obs % 2 = 0"))
    for given in (rows, twice):
        got = {r["cell"]: (r["pattern_id"], r["n"]) for r in patterns.patterns(given).collect()}
        assert got == {c: (k, len(sets[c])) for c, k in ids_of(sets).items()}
    known = patterns.dictionary(patterns.cell_bits(rows))
    found = {}
    for r in patterns.members(known).collect():
        found.setdefault(r["pattern_id"], set()).add(r["obs"])
    assert found == {k: set(sets[c]) for c, k in ids_of(sets).items()}


def test_forms_by_pattern(spark, study):
    rows, design, sets = study
    want = {r["cell"]: r for r in product_forms(rows, XS).where("n > 0").collect()}
    got = {r["cell"]: r for r in patterns.forms_by_pattern(rows, design, XS).collect()}
    assert got.keys() == want.keys() and {c: r["pattern_id"] for c, r in got.items()} == ids_of(sets)
    for c, r in got.items():
        assert (r["n"], r["n_rows"]) == (want[c]["n"], want[c]["n_rows"])
        for k in ("xtx", "xty", "yty"):
            np.testing.assert_allclose(r[k], want[c][k])


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_merged_dictionaries(spark, study, batches):
    rows, design, sets = study
    some = rows.where("NOT (cell = 3 AND obs > 5)")  # a cell that a batch may lack
    merged = None
    for k in range(batches):
        batch = patterns.batch_forms(some.where(F.pmod("obs", F.lit(batches)) == k), design, XS)
        merged = batch if merged is None else patterns.merge(merged, batch)
    got = {r["cell"]: r for r in merged[0].join(merged[1], "pattern_id").collect()}
    want = {r["cell"]: r for r in product_forms(some, XS).where("n > 0").collect()}
    here = {c: frozenset(o for o in s if c != 3 or o <= 5) for c, s in sets.items()}
    assert {c: r["pattern_id"] for c, r in got.items()} == ids_of(here)
    for c, r in got.items():
        assert r["n"] == want[c]["n"]
        np.testing.assert_allclose(r["xtx"], want[c]["xtx"])


def test_overlap(spark, study):
    rows, _, sets = study
    known = patterns.dictionary(patterns.cell_bits(rows))
    by_id = {k: sets[c] for c, k in ids_of(sets).items()}
    pairs = [(a, b) for a in by_id for b in by_id if a != b]
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in patterns.overlap(known, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(a, b): (len(by_id[a] & by_id[b]), len(by_id[a] - by_id[b]), len(by_id[b] - by_id[a]), len(by_id[a] ^ by_id[b]), by_id[a] <= by_id[b]) for a, b in pairs}


def test_nothing(spark):
    none = spark.createDataFrame([], "obs long, cell long, y double, x0 double")
    design = spark.createDataFrame([], "obs long, x0 double")
    assert patterns.patterns(none).count() == 0 and patterns.forms_by_pattern(none, design, ["x0"]).count() == 0
