"""``python -m gridols.jobs.cli config.yml``: fits images as a YAML file says, and writes maps and images to its outdir.

Keys: Y_files (text file of image paths), X (delimited design), contrasts, outdir; optional analysis_mask (an image),
data_mask_files (text file), data_mask_thresh, Missingness (MinPercent, MinN), OutputCovB, minlog.
"""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.operators import contrasts, maps, mask, validate
from gridols.operators.clean import attach_design, clean, join_mask, within
from gridols.operators.fit import fit, full_rank, low_rank_removed
from gridols.operators.products import product_forms
from gridols.operators.ranking import numbered
from gridols.sources.delimited import read_matrix, read_paths
from gridols.sources.folders import qualified, write_text
from gridols.sources.images import read_images, write_images
from gridols.spec import from_config, read_yaml


def run(spark: SparkSession, config: dict) -> DataFrame:
    """All maps in long form, also written under outdir: maps/ as Parquet, images/<map>.nii in the inputs' space, and the configuration."""
    import yaml

    missing = [k for k in ("Y_files", "X", "contrasts", "outdir") if not config.get(k)]
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    paths = read_paths(config["Y_files"])
    matrix = read_matrix(spark, config["X"])
    xs = [c for c in matrix.columns if c != "row"]
    model = from_config(config, len(xs))
    design = numbered(matrix, "row").withColumn("obs", F.col("number") - 1).drop("row", "number")
    validate.rows_match(len(paths), design.count())
    readings, meta = read_images(spark, paths)
    meta = meta.persist()
    validate.geometry(meta)
    first = meta.first()
    shape, affine = tuple(first["shape"]), np.array(first["affine"]).reshape(4, 4)
    if config.get("data_mask_files"):
        named = read_paths(config["data_mask_files"])
        validate.mask_count(len(paths), len(named))
        masks, about = read_images(spark, named)
        validate.geometry(meta.unionByName(about))
        readings = join_mask(readings, masks.withColumnRenamed("y", "mask"), ["obs", "cell"])
    analysis = None
    if config.get("analysis_mask"):
        inside, about = read_images(spark, [config["analysis_mask"]])
        validate.geometry(meta.unionByName(about))
        readings = within(readings, inside.select("cell", F.col("y").alias("mask")), check=True)  # the doubles are checked
        analysis = inside.select("cell", F.col("y").cast("int").alias("mask"))
    rows = attach_design(clean(readings, "mask" if config.get("data_mask_files") else None, model.threshold), design)
    forms = product_forms(rows, xs).persist()  # a row for each cell: what follows reads it several times, the images once
    kept = mask.analysed(forms, model.p, len(paths), model.min_percent, model.min_n, analysis)
    fitted = fit(kept, model.p)
    counts = low_rank_removed(mask.count_maps(forms, model.p, len(paths), model.min_percent, model.min_n, analysis), fitted, model.p)
    out = contrasts.infer(full_rank(fitted, model.p), model)
    every = maps.result_maps(out, model).unionByName(maps.stacked_maps(counts, {c: F.col(c) for c in ("n", "edf", "mask")}, {}))
    maps.write(every, f"{config['outdir']}/maps")
    written = spark.read.parquet(f"{config['outdir']}/maps")
    write_images(written, f"{config['outdir']}/images", shape, affine)
    write_text(next(qualified(spark, [f"{config['outdir']}/inputs.yml"])), yaml.safe_dump(config))
    meta.unpersist()
    forms.unpersist()
    return written


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("gridols")
    run((builder.master(args.master) if args.master else builder).getOrCreate(), read_yaml(args.config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
