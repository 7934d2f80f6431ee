"""Readings laid out as a table of observations by cells, for a check by another program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_block(rows: DataFrame, cells: list[int], min_percent: float = 0.0) -> DataFrame:
    """(obs, c<cell>, ...) of one block of cells of (obs, cell, y): 0 where there is no reading.

    A cell with readings in less than ``min_percent`` of the observations is 0 throughout. All observations of the input have
    a row, whichever cells they have readings of. The cells are named by the caller, a block of them at a time (see
    ``maps.blocks``), so the table's width does not grow with the data and no pass is needed to find them. Two readings of
    an observation and cell are added up.
    """
    n = rows.agg(F.count_distinct("obs")).first()[0]
    inside = F.col("cell").isin(*cells)
    seen = rows.where(inside & (F.col("y") != 0)).groupBy("cell").agg(F.count_distinct("obs").alias("seen"))
    enough = seen.where(F.col("seen") >= min_percent * n).select(F.col("cell").alias("of"))  # at most len(cells) rows
    told = rows.join(F.broadcast(enough), F.col("cell") == F.col("of"), "left").select("obs", "cell", F.when(F.col("of").isNotNull(), F.col("y")).alias("y"))
    wide = told.groupBy("obs").pivot("cell", cells).agg(F.sum("y"))
    return wide.select("obs", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"c{c}") for c in cells))
