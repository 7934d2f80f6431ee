"""Planted-truth data: a design with an intercept, known coefficients whose last is zero, noise, random gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridols.operators.maps import place


def uniform(seed: int, *key):
    """U(0, 1) as a function of the key alone, so that a row has its value however the data is partitioned, on any engine."""
    text = F.concat_ws(":", F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 40))


def normal(seed: int, *key):
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * F.pi() * uniform(seed + 1, *key))


def design(spark: SparkSession, n: int, p: int, seed: int = 1) -> DataFrame:
    """(obs, x0, ...): x0 is 1, the others U(-0.5, 0.5)."""
    rows = spark.range(n).withColumnRenamed("id", "obs")
    return rows.select("obs", F.lit(1.0).alias("x0"), *((uniform(seed + 10 * k, "obs") - 0.5).alias(f"x{k}") for k in range(1, p)))


def simulate(spark: SparkSession, n: int, p: int, cells: int, seed: int = 1, noise: float = 10.0, missing: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(readings (obs, cell, y), design); the coefficients are p - 1, ..., 1, 0."""
    x = design(spark, n, p, seed)
    return planted(x, p, cells, seed, noise, missing), x


def kernel(fwhm: float, reach: int) -> list[float]:
    """Gaussian weights of the offsets -reach to reach, which sum to 1."""
    sigma = fwhm / 2.354820045030949
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def filled(values: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(obs, cell, y) of every cell of the grid, 0 where there is no reading."""
    every = values.select("obs").distinct().select("obs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[0] * shape[1] * shape[2] - 1).cast("long"))).alias("cell"))
    return every.join(values, ["obs", "cell"], "left").select("obs", "cell", F.coalesce("y", F.lit(0.0)).alias("y"))


def smooth(values: DataFrame, shape: tuple[int, int, int], fwhm: float, reach: int = 3) -> DataFrame:
    """(obs, cell, y) smoothed along each axis with a Gaussian kernel that sums to 1; what is outside the grid is 0.

    Along an axis every line of cells is a window, framed by the distance to the cell; a reading is shuffled once an axis.
    Cells without a reading count as 0 and stay without one; ``filled`` gives them one.
    """
    weights = F.array(*map(F.lit, kernel(fwhm, reach)))
    nx, ny, nz = shape
    for stride, size in ((ny * nz, nx), (nz, ny), (1, nz)):
        at = (F.floor(F.col("cell") / stride) % size).cast("long")
        line = Window.partitionBy("obs", F.col("cell") - at * stride).orderBy(at).rangeBetween(-reach, reach)
        near = values.select("obs", "cell", at.alias("at"), F.collect_list(F.struct(at.alias("at"), "y")).over(line).alias("near"))
        y = F.aggregate("near", F.lit(0.0), lambda total, r: total + r["y"] * F.get(weights, (r["at"] - F.col("at") + reach).cast("int")))
        values = near.select("obs", "cell", y.alias("y"))
    return values


def ellipsoid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """(cell, mask): 1 inside the ellipsoid that touches the grid's faces, 0 outside."""
    away = sum(((2 * (at + F.lit(0.5)) / F.lit(size) - 1) ** 2 for at, size in zip(place(shape, F.col("id")), shape, strict=True)), F.lit(0.0))
    return spark.range(shape[0] * shape[1] * shape[2]).select(F.col("id").alias("cell"), (away <= 1).cast("int").alias("mask"))


def cut_smooth(rough: DataFrame, shape: tuple[int, int, int], fwhm: float = 10.0, reach: int = 13, level: float = 0.6) -> DataFrame:
    """(obs, cell, mask): 1 where the rough values (obs, cell, y), smoothed, are over ``level``."""
    return smooth(rough, shape, fwhm, reach).select("obs", "cell", (F.col("y") > level).cast("int").alias("mask"))


def irregular_masks(base: DataFrame, n: int, shape: tuple[int, int, int], seed: int = 1, noise: float = 8.0, fwhm: float = 10.0, reach: int = 13, level: float = 0.6) -> DataFrame:
    """(obs, cell, mask) of n observations: the base mask (cell, mask) with noise, smoothed and cut at ``level``, so that edges differ by observation."""
    each = base.select("cell", "mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("obs"))
    return cut_smooth(each.select("obs", "cell", (F.col("mask") + noise * normal(seed, "obs", "cell")).alias("y")), shape, fwhm, reach, level)


def planted(design_of: DataFrame, p: int, cells: int, seed: int = 1, noise: float = 10.0, missing: float = 0.1) -> DataFrame:
    """Readings (obs, cell, y) of a given design (obs, x0, ...) with the coefficients p - 1, ..., 1, 0."""
    signal = sum((F.col(f"x{k}") * (p - 1 - k) for k in range(1, p)), F.col("x0") * (p - 1))
    grid = design_of.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    y = F.when(uniform(seed + 7, "obs", "cell") < missing, 0.0).otherwise(signal + noise * normal(seed + 3, "obs", "cell"))
    return grid.select("obs", "cell", y.alias("y"))
