"""Queries that begin with files: the given tables written as a study (images, masks, design, lists, configuration), read by the library.

The study's files are made by Spark from the embeddings, one image a vector, in the shared folder; they grow with the table.
"""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.jobs import cli
from gridols.jobs import fixtures as fx
from gridols.operators import validate
from gridols.operators.clean import clean, join_mask
from gridols.operators.ranking import numbered
from gridols.sources.delimited import read_matrix, read_paths
from gridols.sources.folders import file_system, shared_folder, write_text
from gridols.sources.images import located, read_images, read_volumes
from gridols.sources.nifti import decode_header, encode, encode_pair
from gridols.sources.observations import from_arrays
from gridols.spec import Contrast, fraction, read_yaml

SHAPE = (4, 4, 4)
AFFINE = np.array([[2.0, 0, 0, -6], [0, 2.0, 0, 4], [0, 0, -3.0, 1], [0, 0, 0, 1]])


def written_images(rows: DataFrame, folder: str, wide: str = "false") -> list[str]:
    """Addresses of one image for each row (obs, values), in the order of obs; rows with ``wide`` get another affine.

    values has the volumes of ``SHAPE`` one after the other. Images of every third obs are zipped and have their affine as a
    quaternion, those of every next one are a pair of files (the values zipped for every other one), the others plain.
    """

    def run(batches):
        fs, path = file_system(f"{folder}/x")
        fs.create_dir(path.rpartition("/")[0])
        for b in batches:
            out = []
            for obs, values, other in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                v, affine = np.moveaxis(np.array(values.as_py(), float).reshape(-1, *SHAPE), 0, -1), np.diag([2.0, 2, 2, 1]) @ AFFINE if other else AFFINE
                v = v[..., 0] if v.shape[-1] == 1 else v
                if obs % 3 == 0:
                    parts = {".nii.gz": gzip.compress(encode(v, affine, by_rows=False), mtime=0)}
                elif obs % 6 == 1:
                    parts = dict(zip((".hdr", ".img"), encode_pair(v, affine)))
                elif obs % 3 == 1:
                    head, data = encode_pair(v, affine)
                    parts = {".img.gz": gzip.compress(data, mtime=0), ".hdr": head}
                else:
                    parts = {".nii": encode(v, affine)}
                for ending, data in parts.items():
                    fs, path = file_system(f"{folder}/{obs}{ending}")
                    with fs.open_output_stream(path, compression=None) as f:  # the same bytes however often a task runs
                        f.write(data)
                out.append(f"{folder}/{obs}{next(iter(parts))}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["obs", "path"])

    many = 2 * rows.sparkSession.sparkContext.defaultParallelism  # the table may lie in few files, and small ones
    return [r[1] for r in sorted(rows.select("obs", "values", F.expr(wide).alias("wide")).repartition(many, "obs").mapInArrow(run, "obs long, path string").collect())]  # a study's path list


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs"), "label", F.col("embedding").cast("array<double>").alias("values"))


#: Volumes of an image in the queries below, and planes that a task reads of the large ones.
VOLUMES = 250


def volume_files(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str, int]]:
    """The vectors as images of ``VOLUMES`` volumes, found by way of a text file that lists them."""
    base = shared_folder(spark, "images")
    block = F.floor(F.col("obs") / VOLUMES)
    several = vectors(spark, sf_dir).groupBy(block.alias("obs")).agg(F.sort_array(F.collect_list(F.struct("obs", "values"))).alias("v"))  # at most VOLUMES a group
    write_text(f"{base}/list.txt", "\n".join(written_images(several.select("obs", F.flatten("v.values").alias("values")), f"{base}/y")) + "\n")
    return located(spark, read_paths(f"{base}/list.txt"))


def image_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By image and volume: voxels and sums that tell a voxel's number; slabs are small, so that plain images are read by several tasks."""
    readings = read_volumes(spark, volume_files(spark, sf_dir), slab_bytes=1 << 15)
    return readings.groupBy("obs", "vol").agg(F.count("*").alias("n_cells"), F.round(F.sum("y"), 6).alias("total"), F.round(F.sum(F.col("cell") * F.col("y")), 5).alias("weighted"))


def image_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes 1 and 2 of every volume, whose bytes alone are read; by image and plane."""
    readings = read_volumes(spark, volume_files(spark, sf_dir), slab_bytes=1 << 15, planes="1:2")
    return readings.groupBy("obs", "plane").agg(F.count("*").alias("n_cells"), F.round(F.sum("y"), 6).alias("total"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))


def image_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by shape and affine; those of label 9 have another affine, so the study is refused."""
    wide = vectors(spark, sf_dir).select("obs", "values", "label")
    _, meta = read_images(spark, written_images(wide, shared_folder(spark, "geometry"), "label = 9"))
    kinds = meta.groupBy("shape", "affine").agg(F.count("*").alias("n_images"))
    return kinds.select(F.col("shape")[0].alias("first_axis"), F.col("affine")[0].alias("scale"), F.col("affine")[3].alias("shift"), "n_images", F.lit(refused(validate.geometry, meta)).alias("refused"))


def delimited_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design with a header line and row names, as a text file; sums over its columns, and over columns times row numbers."""
    matrix = read_matrix(spark, written_design(spark, sf_dir, names=True))
    rows = numbered(matrix, "row")
    return rows.agg(F.count("*").alias("n_rows"), *(F.sum(f"x{k}").alias(f"sum{k}") for k in range(2)), *(F.sum(F.col(f"x{k}") * F.col("number")).alias(f"weighted{k}") for k in range(2)))


def written_design(spark: SparkSession, sf_dir: str, names: bool = False) -> str:
    """One text file of the design: rows of a design are as many as observations, and their order counts."""
    path = f"{shared_folder(spark, 'design')}/x.csv"
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").toLocalIterator()
    lines = [",intercept,label"] if names else []
    lines += [f"{f'v{i},' if names else ''}1,{label}" for i, label in rows]
    write_text(path, "\n".join(lines) + "\n")
    return path


def study(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    """(configuration, maps) of a study run as from the command line: images, data masks, an analysis mask, a threshold, two contrasts."""
    import yaml

    base = shared_folder(spark, "study")
    rows = vectors(spark, sf_dir)
    seen = rows.select("obs", F.transform("values", lambda _, i: F.when((F.col("obs") + i) % 7 != 0, 1.0).otherwise(0.0)).alias("values"))
    inside = spark.range(1).select(F.col("id").alias("obs"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 16 == 5, 0.0).otherwise(1.0)).alias("values"))
    write_text(f"{base}/y.txt", "\n".join(written_images(rows, f"{base}/y")))
    write_text(f"{base}/m.txt", "\n".join(written_images(seen, f"{base}/m")))
    config = {
        "Y_files": f"{base}/y.txt", "X": written_design(spark, sf_dir), "data_mask_files": f"{base}/m.txt", "analysis_mask": written_images(inside, f"{base}/a")[0], "data_mask_thresh": -0.1,
        "Missingness": {"MinPercent": "50%"}, "OutputCovB": False, "outdir": f"{base}/out", "contrasts": [{"c1": {"name": "label", "vector": "[0 1]"}}, {"c2": {"name": "both", "vector": "[[1 0] [0 1]]"}}],
    }
    write_text(f"{base}/inputs.yml", yaml.safe_dump(config))
    return config, cli.run(spark, read_yaml(f"{base}/inputs.yml"))


def config_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = study(spark, sf_dir)[1].where("map IN ('n', 'edf', 'mask', 'beta', 'resms', 'con', 'conSE', 'conT')")
    return maps.select(F.col("map").cast("string").alias("map"), "vol", "cell", F.round("value", 6).alias("value"))


def exported_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported coefficient image read back: a value for each voxel and volume, 0 outside the mask, in the inputs' space."""
    config, _ = study(spark, sf_dir)
    readings, meta = read_images(spark, [f"{config['outdir']}/images/beta.nii"])
    same = (F.col("shape") == F.array(*map(F.lit, (*SHAPE, 2)))) & (F.col("affine") == F.array(*map(F.lit, AFFINE.ravel().tolist())))
    told = meta.select("obs", same.alias("in_place"))
    place = F.col("cell")
    return readings.join(told, "obs").select(F.floor(place / 2).alias("cell"), (place % 2).cast("int").alias("vol"), F.round("y", 6).alias("value"), "in_place")


def data_mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings joined to a table of masks, fractional in places, which lacks a row for every sixteenth voxel."""
    readings = from_arrays(fx.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    masks = readings.where("cell % 16 <> 0").select("obs", "cell", F.when((F.col("obs") + F.col("cell")) % 7 == 0, 0.0).when(F.col("cell") % 5 == 0, 0.5).otherwise(1.0).alias("mask"))
    rows = clean(join_mask(readings, masks, ["obs", "cell"]), mask="mask")
    return rows.groupBy("cell").agg(F.count_if(F.col("y") != 0).alias("n"), F.round(F.sum("y"), 6).alias("total"))


def refused(check, *given) -> bool:
    try:
        check(*given)
    except ValueError:
        return True
    return False


def study_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks refuse a study whose design lacks the vectors of label 9 and whose masks are those of even vectors."""
    n, rows, masks = vectors(spark, sf_dir).agg(F.count("*"), F.count_if(F.col("label") != 9), F.count_if(F.col("obs") % 2 == 0)).first()
    repeated = from_arrays(fx.table(spark, sf_dir, "embeddings").withColumn("vec_id", F.floor(F.col("vec_id") / 2)), "vec_id", "embedding")
    told = {
        "design_rows": refused(validate.rows_match, n, rows), "all_rows": refused(validate.rows_match, n, n), "mask_count": refused(validate.mask_count, n, masks), "no_masks": refused(validate.mask_count, n, 0),
        "min_percent": refused(fraction, n / max(1, rows)), "share": refused(fraction, f"{100 * rows / max(1, n)}%"), "contrast_width": refused(Contrast.of("c", [1.0] * 3).check, 2),
        "contrast_rank": refused(Contrast.of("c", [[0, n], [0, rows]]).check, 2), "full_rank": refused(Contrast.of("c", [[n, rows], [0, 1]]).check, 2), "repeated_readings": refused(validate.unique_readings, repeated),
        "short_header": refused(decode_header, b""),
    }
    return spark.createDataFrame(list(told.items()), "check string, refused boolean")


QUERIES = {f.__name__: f for f in (image_readings, image_slabs, image_geometry, delimited_design, config_study, exported_images, data_mask_join, study_checks)}

READ = "SELECT vec_id AS obs, label AS x1, unnest(range(len(embedding))) AS cell, CAST(unnest(embedding) AS DOUBLE) AS y0 FROM embeddings"
STUDY = f"""WITH seen AS (SELECT obs, cell, CAST(x1 AS DOUBLE) AS x1, y0 * CASE WHEN (obs + cell) % 7 <> 0 THEN 1 ELSE 0 END AS y1 FROM ({READ}) WHERE cell % 16 <> 5),
    clean AS (SELECT *, CASE WHEN y1 < -0.1 THEN 0 ELSE y1 END AS y FROM seen),
    f AS (SELECT cell, count(*) AS n_rows, count(*) FILTER (WHERE y <> 0) AS n, sum(CASE WHEN y <> 0 THEN x1 ELSE 0 END) AS sx, sum(CASE WHEN y <> 0 THEN x1 * x1 ELSE 0 END) AS sxx, sum(y) AS sy, sum(x1 * y) AS sxy, sum(y * y) AS syy FROM clean GROUP BY cell),
    k AS (SELECT *, n * sxx - sx * sx AS det FROM f WHERE n >= 0.5 * n_rows AND n > 3),
    b AS (SELECT *, (sy * sxx - sx * sxy) / det AS b0, (n * sxy - sx * sy) / det AS b1 FROM k),
    r AS (SELECT *, (syy - b0 * sy - b1 * sxy) / (n - 2) AS resms FROM b),
    t AS (SELECT *, sqrt(n / det * resms) AS se FROM r)"""
SQL = {
    "image_readings": f"""WITH v AS (SELECT vec_id, dense_rank() OVER (ORDER BY vec_id // 250) - 1 AS obs, row_number() OVER (PARTITION BY vec_id // 250 ORDER BY vec_id) - 1 AS vol FROM embeddings)
        SELECT v.obs, CAST(vol AS INTEGER) AS vol, count(*) AS n_cells, round(sum(y0), 6) AS total, round(sum(cell * y0), 5) AS weighted FROM ({READ}) q JOIN v ON q.obs = vec_id GROUP BY v.obs, vol""",
    "image_slabs": f"""WITH v AS (SELECT vec_id, dense_rank() OVER (ORDER BY vec_id // 250) - 1 AS obs FROM embeddings)
        SELECT v.obs, CAST(cell % 4 AS INTEGER) AS plane, count(*) AS n_cells, round(sum(y0), 6) AS total, CAST(min(cell) AS BIGINT) AS first_cell, CAST(max(cell) AS BIGINT) AS last_cell FROM ({READ}) q JOIN v ON q.obs = vec_id WHERE cell % 4 IN (1, 2) GROUP BY v.obs, 2""",
    "image_geometry": "SELECT 4 AS first_axis, CASE WHEN label = 9 THEN 4.0 ELSE 2.0 END::DOUBLE AS scale, CASE WHEN label = 9 THEN -12.0 ELSE -6.0 END::DOUBLE AS shift, count(*) AS n_images, count(*) < (SELECT count(*) FROM embeddings) AS refused FROM embeddings GROUP BY label = 9",
    "delimited_design": "SELECT count(*) AS n_rows, CAST(count(*) AS DOUBLE) AS sum0, CAST(sum(label) AS DOUBLE) AS sum1, CAST(sum(k) AS DOUBLE) AS weighted0, CAST(sum(label * k) AS DOUBLE) AS weighted1 FROM (SELECT label, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings)",
    "config_study": f"""{STUDY}
        SELECT 'n' AS map, 0 AS vol, cell, CAST(n AS DOUBLE) AS value FROM f UNION ALL SELECT 'edf', 0, cell, CAST(greatest(n - 2, 0) AS DOUBLE) FROM f UNION ALL SELECT 'mask', 0, cell, CAST(n >= 0.5 * n_rows AND n > 3 AS INTEGER)::DOUBLE FROM f
        UNION ALL SELECT 'beta', 0, cell, round(b0, 6) FROM t UNION ALL SELECT 'beta', 1, cell, round(b1, 6) FROM t UNION ALL SELECT 'resms', 0, cell, round(resms, 6) FROM t
        UNION ALL SELECT 'con', 0, cell, round(b1, 6) FROM t UNION ALL SELECT 'conSE', 0, cell, round(se, 6) FROM t UNION ALL SELECT 'conT', 0, cell, round(b1 / se, 6) FROM t""",
    "exported_images": f"""{STUDY}, g AS (SELECT unnest(range(64)) AS cell),
        v AS (SELECT g.cell, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1 FROM g LEFT JOIN t ON g.cell = t.cell)
        SELECT cell, 0 AS vol, round(b0, 6) AS value, true AS in_place FROM v UNION ALL SELECT cell, 1, round(b1, 6), true FROM v""",
    "data_mask_join": f"WITH m AS (SELECT cell, y0 * CASE WHEN cell % 16 = 0 OR (obs + cell) % 7 = 0 THEN 0 WHEN cell % 5 = 0 THEN 0.5 ELSE 1 END AS y FROM ({READ})) SELECT cell, count(*) FILTER (WHERE y <> 0) AS n, round(sum(y), 6) AS total FROM m GROUP BY cell",
    "study_checks": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label <> 9) AS k, count(*) FILTER (WHERE vec_id % 2 = 0) AS m FROM embeddings)
        SELECT 'design_rows' AS "check", n <> k AS refused FROM c UNION ALL SELECT 'all_rows', false UNION ALL SELECT 'mask_count', m > 0 AND m <> n FROM c UNION ALL SELECT 'no_masks', false
        UNION ALL SELECT 'min_percent', n > k FROM c UNION ALL SELECT 'share', false UNION ALL SELECT 'contrast_width', true UNION ALL SELECT 'contrast_rank', true UNION ALL SELECT 'full_rank', n = 0 FROM c
        UNION ALL SELECT 'repeated_readings', (SELECT count(*) FROM (SELECT vec_id // 2 FROM embeddings GROUP BY 1 HAVING count(*) > 1)) > 0 UNION ALL SELECT 'short_header', true""",
}
