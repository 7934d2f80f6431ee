"""Results as maps: long form (map, vol, cell, value), dense form with 0 outside the mask, blocks of cells."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.operators import ranking
from gridols.spec import Model

SCALARS = {"resms": "resms", "llh": "llh"}


def long_map(results: DataFrame, name: str, value: Column, vol: Column | int = 0) -> DataFrame:
    return results.select(F.lit(name).alias("map"), (F.lit(vol) if isinstance(vol, int) else vol).cast("int").alias("vol"), "cell", value.cast("double").alias("value"))


def stacked_maps(results: DataFrame, scalars: dict[str, Column], arrays: dict[str, Column]) -> DataFrame:
    """(map, vol, cell, value) of several maps from one pass over the results: each cell's values as one array, exploded."""
    entry = lambda name, vol, value: F.struct(F.lit(name).alias("map"), vol.cast("int").alias("vol"), value.cast("double").alias("value"))
    single = F.array(*(entry(name, F.lit(0), value) for name, value in scalars.items()))
    several = [F.transform(value, partial(lambda name, x, i: entry(name, i, x), name)) for name, value in arrays.items()]
    return results.select("cell", F.explode(F.concat(single, *several)).alias("m")).select("m.map", "m.vol", "cell", "m.value")


def result_maps(results: DataFrame, model: Model) -> DataFrame:
    """All maps of an inferred fit in long form; the covariance only if the model asks for it."""
    arrays = {"beta": "beta", "con": "con", "conSE": "con_se", "conT": "con_t", "conTlp": "con_t_lp", "conF": "con_f", "conFlp": "con_f_lp", "conR2": "con_r2"}
    values = {m: F.col(c) for m, c in arrays.items()}
    if model.output_cov:
        values["cov"] = F.transform("inverse", lambda x: x * F.col("resms"))
    return stacked_maps(results, {m: F.col(c) for m, c in SCALARS.items()}, values)


def union_maps(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dense(spark: SparkSession, values: DataFrame, cells: int, value: str = "value") -> DataFrame:
    """(cell, value) of every cell of the grid, 0 where there is none."""
    grid = spark.range(cells).withColumnRenamed("id", "cell")
    return grid.join(values.select("cell", F.col(value).alias("value")), "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def upsert(old: DataFrame, block: DataFrame) -> DataFrame:
    """(map, vol, cell, value) of old with the block's values in their places."""
    keys = ["map", "vol", "cell"]
    return old.join(block.select(*keys), keys, "left_anti").unionByName(block.select(*old.columns))


def blocks(cells: DataFrame, k: int) -> DataFrame:
    """(cell, block): k contiguous blocks from 0, sizes at most one apart, the larger ones first."""
    return ranking.blocks(cells.select("cell"), "cell", k)


def place(shape: tuple[int, int, int], cell: Column) -> tuple[Column, Column, Column]:
    """(i, j, k) of a cell number; the last axis runs fastest."""
    _, ny, nz = shape
    return F.floor(cell / (ny * nz)), F.floor(cell / nz) % ny, cell % nz


def write(maps: DataFrame, path: str) -> None:
    """Maps as Parquet, partitioned by map, replacing an earlier run."""
    maps.write.mode("overwrite").partitionBy("map").parquet(path)
