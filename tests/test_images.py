import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridols.operators import validate
from gridols.sources import images, nifti, volumes

AFFINE = np.array([[2.0, 0, 0, -8], [0, 2.5, 0, 4], [0, 0, -3, 1], [0, 0, 0, 1]])


def patched(data: bytes, *changes) -> bytes:
    out = bytearray(data)
    for kind, at, *values in changes:
        struct.pack_into(f"<{kind}", out, at, *values)
    return bytes(out)


def rows(df):
    return {(r["obs"], r["vol"], r["cell"]): r["y"] for r in df.collect()}


def truth(volume, obs=0):
    volume = volume[..., None] if volume.ndim == 3 else volume
    flat = volume.reshape(-1, volume.shape[3])
    return {(obs, t, c): flat[c, t] for c in range(len(flat)) for t in range(volume.shape[3])}


@pytest.mark.parametrize(("slope", "inter", "factor", "shift"), [(0, 5, 1, 0), (float("nan"), 5, 1, 0), (float("inf"), 5, 1, 0), (1, 5, 1, 5), (2, float("nan"), 2, 0), (2, 5, 2, 5), (1, 0, 1, 0)])
def test_scaling(slope, inter, factor, shift):
    v = np.arange(8.0).reshape(2, 2, 2)
    got, _ = nifti.decode(patched(nifti.encode(v), ("2f", 112, slope, inter)))
    assert (got == v * factor + shift).all()


def test_whole_number_images_of_both_byte_orders():
    v = np.arange(12).reshape(2, 3, 2)
    for order in "<>":
        head = bytearray(352)
        struct.pack_into(f"{order}i", head, 0, 348)
        struct.pack_into(f"{order}8h", head, 40, 3, 2, 3, 2, 1, 1, 1, 1)
        struct.pack_into(f"{order}2h", head, 70, 4, 16)
        struct.pack_into(f"{order}4f", head, 76, 1, 2, 3, 4)
        struct.pack_into(f"{order}3f", head, 108, 352, 0.5, 1)
        got, affine = nifti.decode(bytes(head) + v.astype(f"{order}i2").tobytes(order="F"))
        assert (got == v * 0.5 + 1).all() and (affine == np.diag([2.0, 3, 4, 1])).all()
    with pytest.raises(ValueError, match="data type"):
        nifti.decode_header(patched(bytes(head[:4][::-1]) + bytes(348), ("h", 70, 1)))


@pytest.mark.parametrize("flip", [1.0, -1.0, 0.0])
@pytest.mark.parametrize("turn", [(0.0, 0.0, 0.0), (0.5, -0.5, 0.1), (1.0, 0.0, 0.0), (0.6, 0.8, 0.0)])
def test_orientation_by_quaternion(turn, flip):
    sizes, offset = (2.0, 3.0, 4.0), (-7.0, 8.0, 9.0)
    data = patched(nifti.encode(np.zeros((2, 2, 2))), ("2h", 252, 1, 0), ("4f", 76, flip, *sizes), ("6f", 256, *turn, *offset), ("12f", 280, *[99.0] * 12))
    affine = nifti.decode_header(data).affine
    q = np.array([np.sqrt(max(0.0, 1 - np.sum(np.square(turn)))), *turn])
    q /= np.linalg.norm(q)

    def product(p, r):
        return np.array([p[0] * r[0] - p[1:] @ r[1:], *(p[0] * r[1:] + r[0] * p[1:] + np.cross(p[1:], r[1:]))])

    for axis in range(3):  # a turned axis is q v q*
        v = np.zeros(4)
        v[1 + axis] = sizes[axis] * (-1 if axis == 2 and flip < 0 else 1)
        np.testing.assert_allclose(affine[:3, axis], product(product(q, v), q * [1, -1, -1, -1])[1:], atol=1e-6)
    assert tuple(affine[:3, 3]) == offset
    assert (nifti.decode_header(patched(data, ("h", 254, 1))).affine[:3] == 99).all()  # the sform comes first
    assert (nifti.decode_header(patched(data, ("h", 252, 0))).affine == np.diag([*sizes, 1])).all()


@pytest.mark.parametrize("signs", [(1, 1, 1), (1, 1, -1), (-1, 1, 1), (-1, -1, 1), (-1, -1, -1)])
def test_both_forms_of_a_written_affine_agree(signs):
    for turn in (np.eye(3), np.linalg.qr(np.random.default_rng(8).normal(size=(3, 3)))[0]):
        affine = np.eye(4)
        affine[:3, :3], affine[:3, 3] = turn * signs * [2.0, 3, 4], [1, -2, 3]
        for by_rows in (True, False):
            np.testing.assert_allclose(nifti.decode_header(nifti.header((2, 2, 2), affine, by_rows=by_rows)).affine, affine, atol=1e-5)
    skewed = np.eye(4)
    skewed[0, 1] = 0.5
    assert (nifti.decode_header(nifti.header((2, 2, 2), skewed)).affine == skewed).all()
    with pytest.raises(ValueError, match="right angles"):
        nifti.header((2, 2, 2), skewed, by_rows=False)


def test_all_kinds_of_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    paths, vols = ["a.nii", "b.nii.gz", "c.img", "d.hdr", "e.img.gz", "f.hdr.gz", "g.img.gz", "h", "i", "j.img"], []
    for p in paths:
        v = rng.normal(size=(3, 2, 4))
        vols.append(v)
        head, values = nifti.encode_pair(v, AFFINE)
        stem = tmp_path / p.split(".")[0]
        files = {"a": {".nii": nifti.encode(v, AFFINE)}, "b": {".nii.gz": gzip.compress(nifti.encode(v, AFFINE))}, "c": {".hdr": head, ".img": values}, "d": {".hdr": head, ".img": values},
                 "e": {".hdr.gz": gzip.compress(head), ".img.gz": gzip.compress(values)}, "f": {".hdr.gz": gzip.compress(head), ".img.gz": gzip.compress(values)}, "g": {".hdr": head, ".img.gz": gzip.compress(values)},
                 "h": {".nii": nifti.encode(v, AFFINE)}, "i": {".hdr.gz": gzip.compress(head), ".img.gz": gzip.compress(values)}, "j": {".hdr.gz": gzip.compress(head), ".img": values}}[p[0]]
        for ending, data in files.items():
            stem.with_suffix(ending).write_bytes(data) if ending.count(".") == 1 else (tmp_path / f"{p[0]}{ending}").write_bytes(data)
    readings, meta = images.read_images(spark, [str(tmp_path / p) for p in paths])
    assert {(r["obs"], r["cell"]): r["y"] for r in readings.collect()} == {(k, c): x for k, v in enumerate(vols) for c, x in enumerate(v.ravel().tolist())}
    assert {(r["obs"], tuple(r["shape"]), tuple(r["affine"])) for r in meta.collect()} == {(k, (3, 2, 4), tuple(AFFINE.ravel())) for k in range(len(paths))}
    validate.geometry(meta)


def test_missing_and_repeated_files(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(nifti.encode(np.zeros((1, 1, 1))))
    (tmp_path / "b.img").write_bytes(bytes(8))
    for name in ("c.nii", "b.img", "c", "none/a.nii"):
        with pytest.raises(ValueError, match=f"{name} does not exist"):
            images.read_images(spark, [str(tmp_path / "a.nii"), str(tmp_path / name)])
    with pytest.raises(ValueError, match="more than once"):
        images.read_images(spark, [str(tmp_path / "a.nii"), str(tmp_path / "a")])
    (tmp_path / "short.nii").write_bytes(nifti.encode(np.zeros((2, 2, 2)))[:-8])
    with pytest.raises(Exception, match="ends before"):
        images.read_images(spark, [str(tmp_path / "short.nii")])[0].count()


@pytest.fixture
def large(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(4, 3, 10, 2))
    (tmp_path / "v.nii").write_bytes(nifti.encode(v, AFFINE))
    (tmp_path / "z.nii.gz").write_bytes(gzip.compress(nifti.encode(v, AFFINE)))
    return v, images.located(spark, [str(tmp_path / "v.nii"), str(tmp_path / "z.nii.gz")])


def test_a_large_image_is_read_by_several_tasks(spark, large):
    v, files = large
    plane = 4 * 3 * 8
    plain = images.read_volumes(spark, files[:1], slab_bytes=3 * plane)
    assert plain.rdd.getNumPartitions() == 2 * 4  # ten planes a volume, three a slab
    assert rows(plain) == truth(v)
    both = images.read_volumes(spark, files, slab_bytes=3 * plane)
    assert both.rdd.getNumPartitions() == 9 and rows(both) == truth(v) | truth(v, 1)


def test_a_slab_reads_its_bytes_only(spark, large):
    v, files = large
    plane, want = 4 * 3 * 8, truth(v)
    for chosen, keep in [
        ({"planes": "4:5"}, lambda c, t: c % 10 in (4, 5)), ({"volumes": "1"}, lambda c, t: t == 1), ({"planes": "9:", "volumes": "0:0"}, lambda c, t: c % 10 == 9 and t == 0),
        ({"cells": "23:26"}, lambda c, t: 23 <= c <= 26), ({"cells": "18:31"}, lambda c, t: 18 <= c <= 31), ({"images": "7"}, lambda c, t: False),
    ]:
        got = images.read_volumes(spark, files[:1], slab_bytes=2 * plane, **chosen)
        assert rows(got) == {k: y for k, y in want.items() if keep(k[2], k[1])}
        zipped = images.read_volumes(spark, files[1:], slab_bytes=2 * plane, **chosen)
        assert rows(zipped) == {(1, *k[1:]): y for k, y in want.items() if keep(k[2], k[1])}
    reader = volumes.ImageReader({"files": __import__("json").dumps(files[:1]), "slab_bytes": 2 * plane, "cells": "23:26", "volumes": "1"})
    (part,) = [p for p in reader.partitions()][:1]
    assert [(s.volumes, s.planes) for p in reader.partitions() for s in p.slabs] == [((1, 1), (3, 4)), ((1, 1), (5, 6))]
    head = nifti.decode_header(volumes.first_bytes(files[0][2]))
    assert [(vol, z, len(data)) for vol, z, _, data in volumes.bytes_of(files[0][1], head, reader.pieces(head, part.slabs[0]))] == [(1, 3, 2 * plane)]


def test_conditions_of_the_query_choose_slabs(spark, large):
    v, files = large
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = images.read_volumes(spark, files, slab_bytes=2 * 4 * 3 * 8)
        few = df.where("obs = 0 AND plane > 2 AND plane <= 4 AND vol < 1")
        assert few.rdd.getNumPartitions() == 1 and rows(few) == {k: y for k, y in truth(v).items() if k[1] == 0 and k[2] % 10 in (3, 4)}
        some = df.where(F.col("plane").isin(0, 9) & (F.col("vol") == 1) & (F.col("y") > 0))
        assert rows(some) == {k: y for k, y in (truth(v) | truth(v, 1)).items() if k[1] == 1 and k[2] % 10 in (0, 9) and y > 0}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def maps_of(spark, volumes_by_name):
    cells = [(m, t, c, float(y)) for m, v in volumes_by_name.items() for (_, t, c), y in truth(v).items() if y]
    return spark.createDataFrame(cells, "map string, vol int, cell long, value double").repartition(3)


def test_maps_are_written_by_slabs_and_replace_an_earlier_run(spark, tmp_path):
    rng = np.random.default_rng(6)
    made = {"beta": rng.normal(size=(4, 3, 5, 3)), "n": rng.normal(size=(4, 3, 5))}
    made["beta"][..., 0, 1] = 0  # a slab without any value
    made["n"][2] = 0
    out = tmp_path / "out"
    assert images.write_images(maps_of(spark, made | {"old": made["n"]}), str(out), (4, 3, 5), AFFINE, slab_bytes=2 * 4 * 3 * 8) == ["beta", "n", "old"]
    assert images.write_images(maps_of(spark, made), str(out), (4, 3, 5), AFFINE, slab_bytes=2 * 4 * 3 * 8) == ["beta", "n"]
    assert sorted(os.listdir(out)) == ["beta.nii", "n.nii"]
    for m, v in made.items():
        got, affine = nifti.decode((out / f"{m}.nii").read_bytes())
        assert (got == v).all() and (affine == AFFINE).all()


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    out, v = tmp_path / "out", np.ones((2, 2, 2))
    images.write_images(maps_of(spark, {"n": v}), str(out), (2, 2, 2))
    before = (out / "n.nii").read_bytes()
    broken = maps_of(spark, {"n": v * 2, "beta": v}).withColumn("value", F.when((F.col("map") == "beta") & (F.col("cell") == 5), F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        images.write_images(broken, str(out), (2, 2, 2))
    assert os.listdir(out) == ["n.nii"] and (out / "n.nii").read_bytes() == before


def test_files_of_tasks_that_ran_twice_do_not_count(tmp_path):
    import pyarrow as pa

    told = {"folder": f"file://{tmp_path}/out", "staging": f"file://{tmp_path}/out/.staging", "sizes": "[4]"}
    batch = pa.RecordBatch.from_pydict({"map": ["n"], "vol": [0], "slab": [0], "place": [2], "value": [1.5]})
    lost, kept = (volumes.SlabWriter(told).write(iter([batch])) for _ in range(2))
    volumes.SlabWriter(told).commit([kept])
    assert lost.files[0][3] != kept.files[0][3]
    listed = __import__("json").loads((tmp_path / "out/.staging/slabs.json").read_text())
    assert [x[3] for x in listed] == [kept.files[0][3]]
    volumes.SlabWriter(told).abort([kept])
    assert os.listdir(tmp_path / "out") == []


def test_an_address_without_a_scheme_is_on_the_default_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    seen = []
    monkeypatch.setattr(images, "qualified", lambda s, paths: seen.append(paths) or iter([f"file://{tmp_path}/elsewhere/x"]))
    images.write_images(maps_of(spark, {"n": np.ones((2, 2, 2))}), "out", (2, 2, 2))
    assert seen == [["out/x"]] and (tmp_path / "elsewhere/n.nii").exists() and not (tmp_path / "out").exists()


def test_small_images_share_batches_and_tasks_are_not_sent_the_list(tmp_path):
    import json
    import pickle

    v = np.random.default_rng(8).normal(size=(50, 2, 3, 4))
    for k in range(50):
        (tmp_path / f"{k}.nii").write_bytes(nifti.encode(v[k], AFFINE))
    files = volumes.locate([f"file://{tmp_path}/{k}.nii" for k in range(50)])
    (tmp_path / "files.json").write_text(json.dumps(files))
    reader = volumes.ImageReader({"listed": f"file://{tmp_path}/files.json", "tasks": 1})
    (part,) = reader.partitions()[:1] if len(reader.partitions()) == 1 else [volumes.Slabs([s for p in reader.partitions() for s in p.slabs])]
    batches = list(reader.read(part))
    assert len(batches) == 1 and len(pickle.dumps(reader)) < 2000
    assert {(o, t, c): y for o, t, _, c, y in zip(*(x.to_pylist() for x in batches[0].columns))} == {k: y for o in range(50) for k, y in truth(v[o], o).items()}
