import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.functions.metrics import compare
from gridols.functions.special import beta_inc, f_sf, minus_log10, t_sf
from gridols.operators import contrasts, maps, mask, validate
from gridols.operators.clean import LARGEST, attach_design, clean, join_mask, outside, within
from gridols.operators.fit import closed_form, fit, full_rank, low_rank_removed, ring_or_inner
from gridols.operators.patterns import combine_patterns, forms_by_pattern, patterns
from gridols.operators.products import add_forms, product_forms
from gridols.sources import delimited, images, simulate
from gridols.spec import Contrast, Model, fraction, from_config, parse_vector

X3 = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def planted(spark):
    """Readings of 40 cells by 60 observations, p = 3; cells below 5 have no gaps."""
    readings, design = simulate.simulate(spark, 60, 3, 40, seed=5, missing=0.2)
    full, _ = simulate.simulate(spark, 60, 3, 40, seed=5, missing=0.0)
    rows = readings.where("cell >= 5").unionByName(full.where("cell < 5"))
    return attach_design(rows, design).cache(), design


def least_squares(rows):
    """By cell, from the rows with y <> 0: what lstsq and the textbook say."""
    out, by = {}, {}
    for r in rows.collect():
        by.setdefault(r["cell"], []).append(r)
    for cell, rs in by.items():
        seen = [r for r in rs if r["y"] != 0]
        x, y = np.array([[r[c] for c in X3] for r in seen]), np.array([r["y"] for r in seen])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        rss, n = float(((y - x @ b) ** 2).sum()), len(y)
        out[cell] = (n, b, rss / (n - 3), -n / 2 * math.log(rss / n) - n / 2 * math.log(2 * math.pi) - n / 2, np.linalg.inv(x.T @ x), x, y)
    return out


def close(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_fit_and_inference_equal_least_squares(spark, planted):
    rows, _ = planted
    model = Model(3, (Contrast.of("f", [[0, 1, 0], [0, 0, 1]]), Contrast.of("t", [0, 1, -1]), Contrast.of("last", "[0 0 1]")))
    got = {r["cell"]: r for r in contrasts.infer(fit(product_forms(rows, X3), 3), model).collect()}
    want = least_squares(rows)
    assert got.keys() == want.keys()
    for cell, (n, b, resms, llh, inv, x, y) in want.items():
        r = got[cell]
        assert (r["n"], r["n_rows"], r["rank"]) == (n, 60, 3) and (n == 60) == (cell < 5)
        for a, w in ((r["beta"], b), (r["resms"], resms), (r["llh"], llh), (np.reshape(r["inverse"], (3, 3)), inv)):
            close(a, w)
        m = np.array([0, 1, -1.0])
        t = m @ b / math.sqrt(m @ inv @ m * resms)
        close([r["con"][0], r["con_se"][0], r["con_t"][0]], [m @ b, math.sqrt(m @ inv @ m * resms), t])
        close(r["con_t_lp"][0], -math.log10(tail(t, n - 3)))
        reduced = y - x[:, :1] @ np.linalg.lstsq(x[:, :1], y, rcond=None)[0]
        ssr = float(reduced @ reduced) - resms * (n - 3)
        f = ssr / 2 / resms
        close([r["con_f"][0], r["con_r2"][0]], [f, 2 * f / (2 * f + n - 3)])
        close(r["con_f_lp"][0], -(n - 3) / 2 * math.log10((n - 3) / (n - 3 + 2 * f)))
        assert len(r["con_t"]) == 2 and len(r["con_f"]) == 1


def tail(t, df):
    """P(T > t) by Simpson's rule on the density, in the angle whose tangent is t over the root of df."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    angles = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 20001)
    v = c * np.cos(angles) ** (df - 1)
    return float((angles[1] - angles[0]) / 3 * (v[0] + v[-1] + 4 * v[1:-1:2].sum() + 2 * v[2:-1:2].sum()))


@pytest.mark.parametrize("df", [1, 2, 5, 97, 400])
def test_tails(df):
    for t in (-3.0, -0.2, 0.0, 0.5, 2.0, 6.0):
        assert t_sf(t, df) == pytest.approx(tail(t, df), rel=1e-7, abs=1e-12)
    f = np.array([0.5, 2.0, 9.0])
    np.testing.assert_allclose(f_sf(f, 2, df), (df / (df + 2 * f)) ** (df / 2), rtol=1e-9)
    assert f_sf(0.0, 2, df) == 1 and np.isnan(f_sf(np.nan, 2, df))


def test_known_far_tail_and_log_rules():
    assert t_sf(40.0, 97) == pytest.approx(2.1766070823751e-62, rel=1e-9)
    assert minus_log10(t_sf(1e200, 100), -9.0) == np.inf  # an underflow stays +inf
    assert minus_log10(np.array([np.inf]), -9.0)[0] == -9.0
    assert beta_inc(0.5, 2, 2) == pytest.approx(0.5)


def test_closed_form_equals_kernel(spark, planted):
    rows, _ = planted
    for xs in (X3, X3[:2], X3[:1]):
        forms = product_forms(rows, xs)
        a = {r["cell"]: r for r in fit(forms, len(xs)).collect()}
        for r in closed_form(forms, len(xs)).collect():
            for c in ("beta", "resms", "sigma2", "inverse"):
                np.testing.assert_allclose(r[c], a[r["cell"]][c], rtol=1e-8, atol=1e-9)


def test_pattern_forms_equal_plain_forms(spark, planted):
    rows, design = planted
    a = {r["cell"]: r for r in product_forms(rows, X3).collect()}
    b = forms_by_pattern(rows, design, X3).collect()
    assert len({r["pattern_id"] for r in b}) == 36  # five cells without gaps share one
    for r in b:
        assert r["n"] == a[r["cell"]]["n"]
        for c in ("xtx", "xty", "yty"):
            close(r[c], a[r["cell"]][c])


@pytest.mark.parametrize("k", [1, 2, 5])
def test_batches_add_up(spark, planted, k):
    rows, _ = planted
    a = {r["cell"]: r for r in product_forms(rows, X3).collect()}
    for r in add_forms(product_forms(rows.withColumn("b", F.col("obs") % k), X3, ("b", "cell")), 3).collect():
        assert (r["n"], r["n_rows"]) == (a[r["cell"]]["n"], 60)
        close(r["xtx"], a[r["cell"]]["xtx"])
        close(r["xty"], a[r["cell"]]["xty"])


def test_combined_batch_patterns(spark, planted):
    rows, _ = planted
    whole = {r["cell"]: r["pattern_id"] for r in patterns(rows).collect()}
    parts = combine_patterns(*(patterns(rows.where(c)) for c in ("obs < 30", "obs >= 30")))
    assert {r["cell"]: r["pattern_id"] for r in parts.collect()} == whole


def test_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, 1.0), (2, inf, 1.0), (3, -inf, 1.0), (4, -0.0, 1.0), (5, None, 1.0), (6, 4.0, 0.5), (7, 2.0, 1.0), (8, 1.9, 1.0)], "cell long, y double, m double")
    assert [r["y"] for r in clean(df).orderBy("cell").collect()] == [0, LARGEST, -LARGEST, 0, 0, 4, 2, 1.9]
    assert [r["y"] for r in clean(df, mask="m", threshold=2.0).orderBy("cell").collect()] == [0, LARGEST, 0, 0, 0, 2, 2, 0]
    assert clean(df, drop_missing=True).count() == 5


def test_masks(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0)], "obs long, cell long, y double")
    m = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.0)], "obs long, cell long, mask double")
    assert [r["mask"] for r in join_mask(rows, m, ["obs", "cell"]).orderBy("obs", "cell").collect()] == [1, 0, 0]
    a = spark.createDataFrame([(1, 1), (2, 0)], "cell long, mask int")
    assert within(rows, a).count() == 2 and outside(rows, a).count() == 1
    with pytest.raises(ValueError, match="0 and 1"):
        within(rows, a.withColumn("mask", F.lit(0.5)), check=True)


def forms_of(spark, counts):
    return spark.createDataFrame([(k, 20, n) for k, n in enumerate(counts)], "cell long, n_rows long, n long")


def test_rules(spark):
    forms = forms_of(spark, [2, 3, 4, 5, 10, 20])
    kept = lambda **how: [r["n"] for r in mask.analysed(forms, 3, F.col("n_rows"), **how).orderBy("cell").collect()]
    assert kept() == [5, 10, 20]
    assert kept(min_percent=0.5) == [10, 20] and kept(min_n=11) == [20] and kept(min_percent=0.25, min_n=6) == [10, 20]
    told = mask.count_maps(forms, 3, 20, min_n=10, analysis_mask=spark.createDataFrame([(4, 1), (5, 0)], "cell long, mask int")).orderBy("cell").collect()
    assert [(r["n"], r["edf"], r["mask"]) for r in told] == [(2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 2, 0), (10, 7, 1), (20, 17, 0)]


def test_low_rank(spark):
    ring = [(1, float(k), 1.0, 0.0) for k in range(1, 9)] + [(1, 0.0, 1.0, 1.0)] + [(2, float(k), 1.0, float(k % 2)) for k in range(1, 10)]
    forms = product_forms(spark.createDataFrame(ring, "cell long, y double, x0 double, x1 double"), ["x0", "x1"])
    fitted = fit(forms, 2)
    removed = low_rank_removed(mask.count_maps(forms, 2, F.col("n_rows")), fitted, 2).orderBy("cell").collect()
    assert [(r["n"], r["edf"], r["mask"]) for r in removed] == [(0, 0, 0), (9, 7, 1)]
    assert [r["cell"] for r in full_rank(fitted, 2).collect()] == [2]
    inner = spark.createDataFrame([(1, float(k), 1.0, 1.0) for k in range(1, 9)], "cell long, y double, x0 double, x1 double")
    with pytest.raises(Exception, match="linearly dependent"):
        full_rank(fit(product_forms(inner, ["x0", "x1"]), 2), 2).collect()


def test_exact_fit_and_nan_t(spark):
    rows = spark.createDataFrame([(1, 3.0, 1.0)] * 6, "cell long, y double, x0 double")
    (r,) = contrasts.infer(fit(product_forms(rows, ["x0"]), 1), Model(1, (Contrast.of("c", [1]),))).collect()
    assert r["beta"] == [3.0] and r["rss"] == 0 and r["llh"] == math.inf and r["con_t"][0] == math.inf and r["con_t_lp"][0] == math.inf
    zero = np.array([np.nan])
    assert contrasts.t_results(Model(1, (Contrast.of("c", [1]),)), np.array([[1.0]]), np.array([[[1.0]]]), zero, np.array([5.0]))[3][0, 0] == 0


def test_contrasts_and_config():
    assert parse_vector("[1 0 0]") == [1, 0, 0] and parse_vector("[[1,0][0,1]]") == parse_vector("[ [1, 0], [0, 1] ]") == [[1, 0], [0, 1]] and parse_vector("[1 -1 .5]") == [1, -1, 0.5]
    with pytest.raises(ValueError, match="rank"):
        Model(2, (Contrast.of("c", [[1, 0], [2, 0]]),))
    with pytest.raises(ValueError, match="columns"):
        Model(3, (Contrast.of("c", [1, 0]),))
    assert fraction("10%") == fraction(0.1)
    with pytest.raises(ValueError):
        fraction(1.5)
    m = from_config({"contrasts": [{"c1": {"name": "a", "vector": [[1, 0], [0, 1]]}}, {"c2": {"name": "b", "vector": [0, 1]}}], "Missingness": {"minpercent": "50%", "MinN": "7"}, "OutputCovB": False}, 2)
    assert ([c.name for c in m.t], [c.name for c in m.f], m.min_percent, m.min_n, m.output_cov) == (["b"], ["a"], 0.5, 7, False)


def test_maps(spark):
    values = spark.createDataFrame([(3, 1.5), (5, 2.5)], "cell long, value double")
    assert [r["value"] for r in maps.dense(spark, values, 7).orderBy("cell").collect()] == [0, 0, 0, 1.5, 0, 2.5, 0]
    sizes = maps.blocks(spark.range(10).withColumnRenamed("id", "cell"), 4).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    i, j, k = maps.place((2, 3, 4), F.col("id"))
    assert [tuple(r) for r in spark.range(24).select(i, j, k).collect()] == list(np.ndindex(2, 3, 4))


def test_result_maps_and_volumes(spark, planted, tmp_path):
    rows, _ = planted
    model = Model(3, (Contrast.of("t", [0, 0, 1]), Contrast.of("f", [[0, 1, 0], [0, 0, 1]])))
    out = contrasts.infer(fit(product_forms(rows, X3), 3), model)
    long = maps.result_maps(out, model)
    counts = {(r["map"], r["vol"]): r["count"] for r in long.groupBy("map", "vol").count().collect()}
    assert counts[("cov", 8)] == 40 and ("cov", 9) not in counts and counts[("conF", 0)] == 40 and len(counts) == 2 + 3 + 4 + 3 + 9
    maps.write(long, str(tmp_path / "maps"))
    back = spark.read.parquet(str(tmp_path / "maps"))
    assert back.count() == long.count()
    affine = np.diag([3.0, 2, 1, 1])
    assert images.write_images(long, str(tmp_path / "images"), (4, 5, 2), affine) == sorted({m for m, _ in counts})
    beta = {r["cell"]: r["beta"] for r in out.collect()}
    volume, found = images.decode((tmp_path / "images/beta.nii").read_bytes())
    assert volume.reshape(40, 3).tolist() == [beta[c] for c in range(40)] and (found == affine).all()
    few = long.where("map = 'cov' AND vol IN (2, 5) AND cell > 7 OR map = 'resms' AND cell = 3").coalesce(1)
    images.write_images(few, str(tmp_path / "few"), (4, 5, 2))
    cov = images.decode((tmp_path / "few/cov.nii").read_bytes())[0].reshape(40, 6)
    assert (cov[:, [0, 1, 3, 4]] == 0).all() and (cov[:8] == 0).all() and (cov[8:, [2, 5]] != 0).all()
    assert np.flatnonzero(images.decode((tmp_path / "few/resms.nii").read_bytes())[0].ravel()).tolist() == [3]


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    vols = [np.arange(24.0).reshape(2, 3, 4), rng.normal(size=(2, 3, 4))]
    affine = np.diag([2.0, 3, 4, 1])
    paths = []
    for k, v in enumerate(vols):
        paths.append(str(tmp_path / f"y{10 - k}.nii"))
        (tmp_path / f"y{10 - k}.nii").write_bytes(images.encode(v, affine))
    readings, meta = images.read_images(spark, paths)
    assert [r["y"] for r in readings.where("obs = 0").orderBy("cell").collect()] == list(range(24))
    assert [r["y"] for r in readings.where("obs = 1").orderBy("cell").collect()] == vols[1].ravel().tolist()
    assert {(tuple(r["shape"]), tuple(r["affine"])) for r in meta.collect()} == {((2, 3, 4), tuple(affine.ravel()))}
    validate.geometry(meta)
    import gzip

    assert (images.decode(gzip.compress(images.encode(vols[0])))[0] == vols[0]).all()
    with pytest.raises(ValueError, match="differs"):
        validate.geometry(meta.withColumn("shape", F.when(F.col("obs") == 1, F.array(F.lit(9))).otherwise(F.col("shape"))))


def test_pairs_zipped_and_relative_images(spark, tmp_path, monkeypatch):
    import gzip

    rng, affine = np.random.default_rng(2), np.diag([1.0, -2, 3, 1])
    monkeypatch.chdir(tmp_path)
    paths = ["11.nii", "1.nii", "sub/1.nii", "2.hdr", "sub/2.img", "3.nii.gz"]
    vols = [rng.normal(size=(2, 2, 3)) for _ in paths]
    (tmp_path / "sub").mkdir()
    for p, v in zip(paths, vols):
        if p[-3:] in ("hdr", "img"):
            for ending, data in zip(("hdr", "img"), images.encode_pair(v, affine)):
                (tmp_path / f"{p[:-3]}{ending}").write_bytes(data)
        else:
            (tmp_path / p).write_bytes(gzip.compress(images.encode(v, affine)) if p.endswith("gz") else images.encode(v, affine))
    readings, meta = images.read_images(spark, [str(tmp_path / p) for p in paths])
    got = {(r["obs"], r["cell"]): r["y"] for r in readings.collect()}
    assert got == {(k, c): x for k, v in enumerate(vols) for c, x in enumerate(v.ravel().tolist())}
    assert sorted(r["obs"] for r in meta.collect()) == list(range(6)) and {tuple(r["affine"]) for r in meta.collect()} == {tuple(affine.ravel())}
    with pytest.raises(ValueError, match="more than once"):
        images.read_images(spark, [str(tmp_path / "1.nii"), f"file://{tmp_path}/1.nii"])
    with pytest.raises(ValueError, match="NIfTI"):
        images.decode_header(b"short")


def test_validation(spark):
    with pytest.raises(ValueError, match="data masks"):
        validate.mask_count(2, 3)
    with pytest.raises(ValueError, match="data masks"):
        validate.mask_count(3, 2)
    with pytest.raises(ValueError, match="design"):
        validate.rows_match(3, 4)
    with pytest.raises(ValueError, match="more than one"):
        validate.unique_readings(spark.createDataFrame([(1, 1), (1, 1)], "obs long, cell long"))


@pytest.mark.parametrize("text,want", [
    ("1,2\n3,4\n", [[1, 2], [3, 4]]), ("a,b\n1,2\n3,4\n", [[1, 2], [3, 4]]), ("r1,1,2\nr2,3,4\n", [[1, 2], [3, 4]]), ("x,a,b\nr1,1,2\nr2,3,4\n", [[1, 2], [3, 4]]),
    (",1,2\n7,1,2\n", [[7, 1, 2]]), (",a,b\n0,1,2\n1,3,4\n", [[1, 2], [3, 4]]), ("a\n1\n2\n", [[1], [2]]), ("1\n2\n", [[1], [2]]), ("r1,5,6\n", [[5, 6]]),
])
def test_delimited(spark, tmp_path, text, want):
    (tmp_path / "m.csv").write_text(text)
    rows = delimited.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("row").drop("row").collect()
    assert [list(r) for r in rows] == want


def test_path_list(tmp_path):
    (tmp_path / "p.txt").write_text("b.nii\na.nii")
    assert delimited.read_paths(str(tmp_path / "p.txt")) == ["b.nii", "a.nii"]


def test_simulation_recovers_the_truth(spark):
    readings, design = simulate.simulate(spark, 400, 3, 30, seed=2, noise=1.0, missing=0.3)
    out = fit(product_forms(attach_design(readings, design), X3), 3).collect()
    assert np.abs(np.mean([r["beta"] for r in out], axis=0) - [2, 1, 0]).max() < 0.15
    assert sorted(map(tuple, simulate.simulate(spark, 9, 2, 3, seed=2)[0].collect())) == sorted(map(tuple, simulate.simulate(spark, 9, 2, 3, seed=2)[0].repartition(5).collect()))


def test_smoothing(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4, 5, 6))
    df = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(v.ravel())], "obs long, cell long, y double")
    got = np.array([r["y"] for r in simulate.smooth(df, v.shape, 3.0, reach=2).orderBy("cell").collect()]).reshape(v.shape)
    w = np.exp(-np.arange(-2, 3) ** 2 / (2 * (3.0 / 2.354820045030949) ** 2))
    w /= w.sum()
    for axis in range(3):
        v = np.apply_along_axis(lambda a: np.convolve(a, w, mode="full")[2:-2], axis, v)
    np.testing.assert_allclose(got, v, atol=1e-12)


def test_irregular_masks(spark):
    shape, n = (8, 9, 10), 3
    base = simulate.ellipsoid(spark, shape)
    centre = [(2 * (np.arange(s) + 0.5) / s - 1) ** 2 for s in shape]
    inside = (centre[0][:, None, None] + centre[1][:, None] + centre[2] <= 1).astype(int)
    assert [r["mask"] for r in base.orderBy("cell").collect()] == inside.ravel().tolist()
    plain = simulate.irregular_masks(base, 1, shape, noise=0.0, fwhm=2.0, reach=2).orderBy("cell").collect()
    smooth = np.array([r["y"] for r in simulate.smooth(base.select(F.lit(0).cast("long").alias("obs"), "cell", F.col("mask").cast("double").alias("y")), shape, 2.0, 2).orderBy("cell").collect()])
    assert [r["mask"] for r in plain] == (smooth > 0.6).astype(int).tolist()
    masks = simulate.irregular_masks(base, n, shape, seed=3, noise=1.0, fwhm=3.0, reach=3)
    got = np.array([r["mask"] for r in masks.orderBy("obs", "cell").collect()]).reshape(n, -1)
    assert got.shape == (n, inside.size) and len({tuple(m) for m in got}) == n
    assert (got[:, inside.ravel() == 0].mean() < 0.2) and 0.3 < got[:, inside.ravel() == 1].mean() < 1
    assert sorted(map(tuple, masks.collect())) == sorted(map(tuple, simulate.irregular_masks(base.repartition(5), n, shape, seed=3, noise=1.0, fwhm=3.0, reach=3).collect()))
    readings = spark.range(n).select(F.col("id").alias("obs")).crossJoin(base.select("cell")).withColumn("y", F.lit(2.0))
    kept = clean(join_mask(readings, masks, ["obs", "cell"]), mask="mask")
    assert kept.where("y <> 0").count() == got.sum()


def test_metrics(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 9.0)], "cell long, value double")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "cell long, value double")
    (r,) = compare(a, b, ["cell"]).collect()
    assert (r["n_compared"], r["mae"]) == (2, 0.5) and r["mrd"] == pytest.approx(1 / 3)


def test_ring_or_inner(spark):
    assert [r[0] for r in forms_of(spark, [20, 19]).orderBy("cell").select(ring_or_inner()).collect()] == ["inner", "ring"]


def test_stream_of_readings_ends_where_the_batch_does(spark, planted, tmp_path):
    from gridols.streaming.incremental import BASE, compact, latest, parts, start_fit

    rows, _ = planted
    for k in range(3):
        rows.where(F.col("obs") % 3 == k).select("cell", "y", *X3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell long, y double, x0 double, x1 double, x2 double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_fit(stream, X3, str(tmp_path / "out"), str(tmp_path / "ck"), every=2).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    assert last >= 2 and parts(spark, str(tmp_path / "out")) == (last - (last + 1) % 2, [last] * ((last + 1) % 2))
    (tmp_path / "out" / str(last + 1)).mkdir()  # a batch that never ended is not read
    compact(spark, str(tmp_path / "out"))
    assert parts(spark, str(tmp_path / "out")) == (last, []) and (tmp_path / "out" / f"{BASE}{last}").is_dir()
    want = {r["cell"]: r for r in fit(product_forms(rows, X3), 3).collect()}
    got = latest(spark, str(tmp_path / "out")).collect()
    assert {r["cell"] for r in got} == want.keys()
    for r in got:
        assert r["n"] == want[r["cell"]]["n"]
        close(r["beta"], want[r["cell"]]["beta"])


def test_numbering_and_blocks_of_uneven_keys(spark):
    from gridols.operators.ranking import blocks, numbered

    rng = np.random.default_rng(0)
    keys = sorted({int(x) for x in np.concatenate([rng.integers(-50, 50, 40), rng.integers(10**9, 10**12, 60)])})
    df = spark.createDataFrame([(k,) for k in keys], "cell long").repartition(3)
    assert [r["number"] for r in numbered(df, "cell").orderBy("cell").collect()] == list(range(1, len(keys) + 1))
    for k in (1, 7, 200):
        want = [b for b, part in enumerate(np.array_split(np.array(keys), k)) for _ in part]
        assert [r["block"] for r in blocks(df, "cell", k).orderBy("cell").collect()] == want
    wide = [-(2**63), -(2**62), *range(50), 2**62, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in wide], "cell long").repartition(3)
    assert [r["number"] for r in numbered(df, "cell").orderBy("cell").collect()] == list(range(1, len(wide) + 1))
    assert numbered(df.limit(0), "cell").count() == 0 and blocks(df.limit(0), "cell", 3).count() == 0
