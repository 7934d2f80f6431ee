"""Readings in long form: (obs, cell, y) with design columns x0, x1, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_arrays(table: DataFrame, obs: str, values: str) -> DataFrame:
    """(obs, cell, y): one reading for each array element; the cell is the element's place."""
    return table.select(F.col(obs).alias("obs"), F.posexplode(values).alias("cell", "y")).select("obs", F.col("cell").cast("long").alias("cell"), "y")


def from_rows(table: DataFrame, cell: Column, y: Column, xs: list[Column]) -> DataFrame:
    """(cell, y, x0, ...): every row is a reading with a design row of its own."""
    return table.select(cell.cast("long").alias("cell"), y.alias("y"), *(x.cast("double").alias(f"x{k}") for k, x in enumerate(xs)))


def design(table: DataFrame, obs: str, xs: list[Column]) -> DataFrame:
    """(obs, x0, ...): a design that all cells share."""
    return table.select(F.col(obs).alias("obs"), *(x.cast("double").alias(f"x{k}") for k, x in enumerate(xs)))
