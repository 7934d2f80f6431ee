import numpy as np
import pytest
import yaml

from gridols.jobs.cli import run
from gridols.sources.images import decode, encode
from gridols.spec import read_yaml


AFFINE = np.array([[2.0, 0, 0, -8], [0, 2.5, 0, 4], [0, 0, -3, 1], [0, 0, 0, 1]])


@pytest.fixture
def study(tmp_path):
    rng = np.random.default_rng(3)
    n, shape = 24, (3, 4, 2)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = 2 + x[:, 1:] * np.linspace(-1, 1, 24) + rng.normal(size=(n, 24))
    y[rng.uniform(size=y.shape) < 0.2] = 0
    y[:, 5] = 0
    masks = (rng.uniform(size=y.shape) < 0.9).astype(float)
    for k in range(n):
        (tmp_path / f"y{k}.nii").write_bytes(encode(y[k].reshape(shape), AFFINE))
        (tmp_path / f"m{k}.nii").write_bytes(encode(masks[k].reshape(shape), AFFINE))
    inside = np.ones(24)
    inside[7] = 0
    (tmp_path / "am.nii").write_bytes(encode(inside.reshape(shape), AFFINE))
    (tmp_path / "y.txt").write_text("\n".join(str(tmp_path / f"y{k}.nii") for k in range(n)))
    (tmp_path / "m.txt").write_text("\n".join(str(tmp_path / f"m{k}.nii") for k in range(n)))
    np.savetxt(tmp_path / "x.csv", x, delimiter=",")
    config = {"Y_files": str(tmp_path / "y.txt"), "X": str(tmp_path / "x.csv"), "outdir": str(tmp_path / "out"), "data_mask_files": str(tmp_path / "m.txt"), "analysis_mask": str(tmp_path / "am.nii"),
              "data_mask_thresh": 0.1, "Missingness": {"MinPercent": "25%"}, "contrasts": [{"c1": {"name": "slope", "vector": "[0 1]"}}]}
    (tmp_path / "c.yml").write_text(yaml.safe_dump(config))
    y = y * masks
    y[y < 0.1] = 0
    return tmp_path, x, y


def test_images_in_maps_out(spark, study):
    path, x, y = study
    before = (path / "c.yml").read_text()
    out = run(spark, read_yaml(str(path / "c.yml")))
    got = {(r["map"], r["vol"], r["cell"]): r["value"] for r in out.collect()}
    cells = {c for m, v, c in got if m == "resms"}
    assert 5 not in cells and 7 not in cells and len(cells) > 15
    for c in cells:
        seen = y[:, c] != 0
        b, rss = np.linalg.lstsq(x[seen], y[seen, c], rcond=None)[:2]
        assert got["beta", 0, c] == pytest.approx(b[0]) and got["beta", 1, c] == pytest.approx(b[1])
        assert got["resms", 0, c] == pytest.approx(rss[0] / (seen.sum() - 2)) and got["n", 0, c] == seen.sum() and got["mask", 0, c] == 1
    beta, affine = decode((path / "out/images/beta.nii").read_bytes())
    assert beta.shape == (3, 4, 2, 2) and beta[..., 1].ravel()[7] == 0 and beta[..., 1].ravel()[min(cells)] == got["beta", 1, min(cells)]
    assert (affine == AFFINE).all() and decode((path / "out/images/n.nii").read_bytes())[0].shape == (3, 4, 2)
    assert sorted(p.name for p in (path / "out/images").glob("*.nii*")) == sorted(f"{m}.nii" for m in {k[0] for k in got})
    assert (path / "c.yml").read_text() == before and read_yaml(f"{path}/out/inputs.yml")["data_mask_thresh"] == 0.1


def test_refuses_wrong_input(spark, study):
    path, _, _ = study
    config = read_yaml(str(path / "c.yml"))
    with pytest.raises(ValueError, match="lacks X"):
        run(spark, config | {"X": None})
    (path / "short.txt").write_text("\n".join((path / "y.txt").read_text().split("\n")[:-1]))
    with pytest.raises(ValueError, match="rows of the design"):
        run(spark, config | {"Y_files": str(path / "short.txt")})
    with pytest.raises(ValueError, match="data masks"):
        run(spark, config | {"data_mask_files": str(path / "short.txt")})


def test_a_fractional_analysis_mask_is_refused(spark, study):
    path, _, _ = study
    half = np.ones((3, 4, 2))
    half[1, 1, 1] = 0.5
    (path / "half.nii").write_bytes(encode(half, AFFINE))
    with pytest.raises(ValueError, match="other than 0 and 1"):
        run(spark, read_yaml(str(path / "c.yml")) | {"analysis_mask": str(path / "half.nii")})


def test_an_earlier_run_is_replaced(spark, study):
    path, _, _ = study
    config = read_yaml(str(path / "c.yml"))
    run(spark, config)
    (path / "out/images/conF.nii").write_bytes(b"of an earlier run")
    run(spark, config | {"contrasts": [{"c1": {"name": "both", "vector": "[[1 0] [0 1]]"}}]})
    names = {p.stem for p in (path / "out/images").glob("*.nii")}
    assert {"conF", "conR2", "beta"} <= names and not names & {"con", "conSE", "conT"}
    assert decode((path / "out/images/conF.nii").read_bytes())[0].shape == (3, 4, 2)
    assert {r[0] for r in spark.read.parquet(f"{path}/out/maps").select("map").distinct().collect()} == names
