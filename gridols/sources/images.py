"""Volumetric images read into rows and written from maps; the format is in ``nifti``, the data source in ``volumes``."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.operators.maps import place
from gridols.sources import volumes
from gridols.sources.folders import kept, qualified, read_text, shared_folder, write_text
from gridols.sources.nifti import decode, decode_header, encode, encode_pair  # noqa: F401  (the codec goes by this module's name too)


def located(spark: SparkSession, paths: list[str]) -> list[tuple[int, str, str, int]]:
    """The files of the images by full address; one that is missing or listed twice is refused."""
    files = volumes.locate(list(qualified(spark, paths)))
    seen: set[str] = set()
    for k, values, _, _ in files:
        if values in seen:
            raise ValueError(f"{paths[k]} is listed more than once")
        seen.add(values)
    return files


def read_volumes(spark: SparkSession, files: list[tuple[int, str, str, int]], slab_bytes: int = volumes.SLAB_BYTES, **chosen: str) -> DataFrame:
    """(obs, vol, plane, cell, y) of located images; chosen: images, volumes, planes or cells as "first:last", which alone are read."""
    spark.dataSource.register(volumes.Images)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    listed = f"{shared_folder(spark, 'listed')}/files.json"
    write_text(listed, json.dumps(files))
    told = {"listed": listed, "slab_bytes": slab_bytes, "tasks": spark.sparkContext.defaultParallelism, "pushdown": pushdown} | chosen
    return spark.read.format(volumes.NAME).options(**told).load()


def read_meta(spark: SparkSession, files: list[tuple[int, str, str, int]]) -> DataFrame:
    """(path, obs, shape, affine) of located images, from the first bytes of their headers."""

    def heads(batches):
        for b in batches:
            told = [decode_header(volumes.first_bytes(f)) for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array([list(t.shape) for t in told], pa.list_(pa.int32())), pa.array([t.affine.ravel().tolist() for t in told], pa.list_(pa.float64()))], ["path", "obs", "shape", "affine"])

    rows = spark.createDataFrame(pa.table({"obs": [f[0] for f in files], "path": [f[1] for f in files], "head": [f[2] for f in files]}, pa.schema([("obs", pa.int64()), ("path", pa.string()), ("head", pa.string())])))
    return rows.mapInArrow(heads, "path string, obs long, shape array<int>, affine array<double>")


def read_images(spark: SparkSession, paths: list[str], slab_bytes: int = volumes.SLAB_BYTES) -> tuple[DataFrame, DataFrame]:
    """(readings (obs, cell, y), meta (path, obs, shape, affine)) of the images; obs is a path's place in the list.

    Cells of an image of several volumes are numbered with the volume fastest. A path may lack its ending, and a pair may be
    named by either of its files; a file that is listed twice, or does not exist, is refused.
    """
    files = located(spark, paths)
    meta = kept(read_meta(spark, files), "meta")  # the headers are read once
    many = meta.where(F.size("shape") > 3).select("obs", F.aggregate(F.slice("shape", 4, 99), F.lit(1).cast("long"), lambda a, n: a * n).alias("volumes"))
    rows = read_volumes(spark, files, slab_bytes)
    if many.limit(1).count():
        each = rows.join(F.broadcast(many) if len(files) < 1 << 16 else many, "obs", "left")
        rows = each.withColumn("cell", F.col("cell") * F.coalesce("volumes", F.lit(1)) + F.col("vol"))
    return rows.select("obs", "cell", "y"), meta


def write_images(maps: DataFrame, folder: str, shape: tuple[int, int, int], affine: np.ndarray | None = None, slab_bytes: int = volumes.SLAB_BYTES) -> list[str]:
    """Each map as ``folder``/<map>.nii with its volumes on the fourth axis, zero where a map has no value; returns the maps' names.

    Slabs of planes are written by tasks of their own and then joined; images that an earlier run left in the folder are
    replaced or removed when all is written, and a failed run changes nothing there.
    """
    spark, (nx, ny, nz) = maps.sparkSession, shape
    folder = next(qualified(spark, [f"{folder}/x"])).rpartition("/")[0]
    spark.dataSource.register(volumes.Images)
    planes = max(1, slab_bytes // (nx * ny * 8))
    sizes = [nx * ny * min(planes, nz - z) for z in range(0, nz, planes)]
    told = {"folder": folder, "staging": f"{folder}/.staging-{uuid.uuid4().hex}", "sizes": json.dumps(sizes), "shape": json.dumps(shape), "affine": json.dumps((np.eye(4) if affine is None else np.asarray(affine, float)).ravel().tolist())}
    i, j, k = place(shape, F.col("cell"))
    slab = F.floor(k / planes)
    rows = maps.select("map", F.col("vol").cast("int").alias("vol"), slab.cast("int").alias("slab"), (((k - slab * planes) * ny + j) * nx + i).cast("long").alias("place"), F.col("value").cast("double").alias("value"))
    keys = ["map", "vol", "slab"]
    try:
        rows.repartition(*keys).sortWithinPartitions(*keys).write.format(volumes.NAME).mode("append").options(stage="slabs", **told).save()
        made = {(m, v, s): name for m, v, s, name in json.loads(read_text(f"{told['staging']}/slabs.json"))}
        names = {}
        for m, v, _ in made:
            names[m] = max(names.get(m, 0), v + 1)
        parts = [(m, n, v * len(sizes) + s, 8 * size, made.get((m, v, s))) for m, n in sorted(names.items()) for v in range(n) for s, size in enumerate(sizes)]
        table = spark.createDataFrame(parts, "map string, volumes int, position long, size long, slab string")
        table.repartition(max(1, len(names)), "map").sortWithinPartitions("map", "position").write.format(volumes.NAME).mode("append").options(stage="files", **told).save()
    except BaseException:
        volumes.remove(told["staging"])
        raise
    return sorted(names)
