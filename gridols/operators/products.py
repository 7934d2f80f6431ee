"""Product forms: counts, X'X, X'Y and Y'Y by cell, in one two-phase hash aggregate.

Sums over X'X take rows with y <> 0 alone; X'Y and Y'Y need no such filter, since a missing y is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def product_sums(xs: list[str], y: str = "y") -> list[Column]:
    seen = F.col(y) != 0
    return [
        F.count("*").alias("n_rows"), F.count_if(seen).alias("n"),
        *(F.sum(F.when(seen, F.col(xs[i]) * F.col(xs[j])).otherwise(F.lit(0.0))).alias(f"xx_{i}_{j}") for i, j in pairs(len(xs))),
        *(F.sum(F.col(x) * F.col(y)).alias(f"xy_{i}") for i, x in enumerate(xs)), F.sum(F.col(y) * F.col(y)).alias("yty"),
    ]


def packed(sums: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Sums as arrays: xtx (row-major, p * p), xty, and yty."""
    full = [F.col(f"xx_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]
    return sums.select(*keys, "n_rows", "n", F.array(*full).alias("xtx"), F.array(*(F.col(f"xy_{i}") for i in range(p))).alias("xty"), "yty")


def product_forms(rows: DataFrame, xs: list[str], keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """(cell, n_rows, n, xtx, xty, yty); p (p + 1) / 2 + p + 3 sums, which codegen takes up to p of about 20."""
    return packed(rows.groupBy(*keys).agg(*product_sums(xs)), list(keys), len(xs))


def add_forms(parts: DataFrame, p: int, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Product forms of batches of observations, added up: the final phase for batches that came separately."""
    added = lambda name, n: F.array(*(F.sum(F.col(name)[k]) for k in range(n))).alias(name)
    return parts.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), added("xtx", p * p), added("xty", p), F.sum("yty").alias("yty"))


def both_all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
