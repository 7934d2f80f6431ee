import numpy as np
import pytest

from gridols.operators import contrasts
from gridols.operators.fit import fit, inverse_and_log_det, inverses
from gridols.operators.products import product_forms
from gridols.operators.sweep import swept, t_statistics
from gridols.operators.wide import pivot_block
from gridols.sources import simulate
from gridols.spec import Contrast, Model


def forms_of(spark, p, seed=1, scales=None, cells=12, n=40):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))]) * (np.ones(p) if scales is None else scales)
    rows = [(c, float(y) if rng.random() > 0.1 else 0.0, *map(float, r)) for c in range(cells) for r, y in zip(x, rng.normal(size=n) + x[:, -1] / np.abs(x[:, -1]).max())]
    names = [f"x{k}" for k in range(p)]
    return product_forms(spark.createDataFrame(rows, f"cell long, y double, {', '.join(f'{c} double' for c in names)}"), names)


@pytest.mark.parametrize("p", [1, 2, 5, 9])
def test_equals_the_stacked_kernel(spark, p):
    forms = forms_of(spark, p)
    a, b = ({r["cell"]: r for r in d.collect()} for d in (fit(forms, p), swept(forms, p)))
    assert a.keys() == b.keys()
    for c, r in a.items():
        assert (r["n"], r["n_rows"], r["rank"]) == (b[c]["n"], b[c]["n_rows"], b[c]["rank"]) and r["rank"] == p
        for k in ("beta", "rss", "resms", "sigma2", "llh", "inverse"):
            np.testing.assert_allclose(b[c][k], r[k], rtol=1e-8, atol=1e-10)
        xtx = np.linalg.inv(np.array(r["inverse"]).reshape(p, p))
        np.testing.assert_allclose(b[c]["log_det"], np.linalg.slogdet(xtx)[1], rtol=1e-8)


def test_t_statistics(spark):
    model = Model(4, (Contrast.of("a", [0, 1, -1, 0]), Contrast.of("f", [[0, 1, 0, 0], [0, 0, 1, 0]]), Contrast.of("b", [1, 0, 0, 2.5])))
    forms = forms_of(spark, 4)
    a = {r["cell"]: r for r in contrasts.infer(fit(forms, 4), model).collect()}
    for r in t_statistics(swept(forms, 4), model).collect():
        for k in ("con", "con_se", "con_t"):
            np.testing.assert_allclose(r[k], a[r["cell"]][k], rtol=1e-9)


def test_low_rank_and_lost_numbers(spark):
    rows = [(1, float(k), 1.0, float(k), 2.0 * k - 1) for k in range(1, 9)] + [(2, float(k), 1.0, float(k % 3), float(k * k)) for k in range(1, 9)] + [(3, 1e200, 1.0, 1e200, 1.0)] * 3 + [(4, 2.0, 1.0, 0.0, 3.0)] * 3
    forms = product_forms(spark.createDataFrame(rows, "cell long, y double, x0 double, x1 double, x2 double"), ["x0", "x1", "x2"])
    got = {r["cell"]: r for r in swept(forms, 3).collect()}
    assert {c: r["rank"] for c, r in got.items()} == {1: 2, 2: 3, 3: 1, 4: 1}
    assert np.isnan(got[1]["beta"]).all() and np.isnan(got[1]["rss"]) and np.isfinite(got[2]["beta"]).all()
    assert swept(forms, 3).where("rank = 3").count() == 1


def test_no_python_worker_and_no_blown_up_plan(spark):
    out = t_statistics(swept(forms_of(spark, 8), 8).where("rank = 8"), Model(8, (Contrast.of("last", [0.0] * 7 + [1.0]),))).where("con[0] > -1e9")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(plan) < 200_000
    assert out.count() == 12


def test_scales_of_columns_do_not_matter(spark):
    scales = np.array([1.0, 1e8, 1e-8])
    forms, plain = forms_of(spark, 3, scales=scales), forms_of(spark, 3)
    want = {r["cell"]: r for r in fit(plain, 3).collect()}
    for got in (fit(forms, 3), swept(forms, 3)):
        for r in got.collect():
            assert r["rank"] == 3
            np.testing.assert_allclose(np.array(r["beta"]) * scales, want[r["cell"]]["beta"], rtol=1e-6)
            np.testing.assert_allclose(np.array(r["inverse"]).reshape(3, 3) * np.outer(scales, scales), np.array(want[r["cell"]]["inverse"]).reshape(3, 3), rtol=1e-6, atol=1e-12)
    for r in inverses(forms, 3).collect():
        x = np.array(want[r["cell"]]["inverse"]).reshape(3, 3)
        np.testing.assert_allclose(r["log_det"], -np.linalg.slogdet(x)[1] + 2 * np.log(scales).sum(), rtol=1e-9)


def test_determinants_take_the_square_of_the_scales():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(5, 4, 4))
    a = a @ a.transpose(0, 2, 1)
    inverse, log_det = inverse_and_log_det(a)
    np.testing.assert_allclose(inverse @ a, np.broadcast_to(np.eye(4), a.shape), atol=1e-8)
    np.testing.assert_allclose(log_det, np.linalg.slogdet(a)[1])


def test_inverses_of_low_rank_are_null(spark):
    rows = [(1, 1.0, 1.0, 2.0)] * 3 + [(2, 1.0, 1.0, float(k)) for k in range(3)]
    got = {r["cell"]: r for r in inverses(product_forms(spark.createDataFrame(rows, "cell long, y double, x0 double, x1 double"), ["x0", "x1"]), 2).collect()}
    assert got[1]["inverse"] is None and got[1]["log_det"] is None and np.isclose(got[2]["log_det"], np.log(6))


def test_pivot(spark):
    rows = [(1, 10, 1.0), (1, 11, 2.0), (2, 10, 3.0), (2, 11, 0.0), (3, 10, 4.0), (3, 10, 5.0), (4, 99, 6.0)]
    df = spark.createDataFrame(rows, "obs long, cell long, y double")
    wide = pivot_block(df, [10, 11, 12], min_percent=0.5)
    assert wide.columns == ["obs", "c10", "c11", "c12"]
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0), (3, 9.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)]
    assert sorted(map(tuple, pivot_block(df, [11]).collect())) == [(1, 2.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_filled_grid_and_sparse_smoothing(spark):
    df = spark.createDataFrame([(7, 0, 1.0), (7, 5, 2.0)], "obs long, cell long, y double")
    dense = simulate.filled(df, (2, 3, 2))
    assert {r["cell"]: r["y"] for r in dense.collect()} == {c: {0: 1.0, 5: 2.0}.get(c, 0.0) for c in range(12)}
    full = {r["cell"]: r["y"] for r in simulate.smooth(dense, (2, 3, 2), 2.0, 1).collect()}
    want = np.zeros((2, 3, 2))
    want.ravel()[[0, 5]] = 1.0, 2.0
    for axis in range(3):
        want = np.apply_along_axis(lambda a: np.convolve(a, simulate.kernel(2.0, 1), mode="full")[1:-1], axis, want)
    np.testing.assert_allclose([full[c] for c in range(12)], want.ravel(), atol=1e-12)
    few = {r["cell"]: r["y"] for r in simulate.smooth(df, (2, 3, 2), 2.0, 1).collect()}
    assert few.keys() == {0, 5}
