"""From readings to cleaned responses: casts, masks, threshold, NaN and infinity; a cleaned 0 means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def cleaned(y: Column, mask: Column | None = None, threshold: float | None = None) -> Column:
    """y as double, times the mask, below the threshold 0, NaN and null 0, infinities the largest double."""
    v = y.cast("double")
    v = v * mask.cast("double") if mask is not None else v
    v = F.when(v < F.lit(float(threshold)), F.lit(0.0)).otherwise(v) if threshold is not None else v
    v = F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))
    inf = F.lit(float("inf"))
    return F.when(v == inf, F.lit(LARGEST)).when(v == -inf, F.lit(-LARGEST)).when(v == 0, F.lit(0.0)).otherwise(v)


def clean(rows: DataFrame, mask: str | None = None, threshold: float | None = None, drop_missing: bool = False) -> DataFrame:
    """Rows (cell, y, design columns) with y cleaned; with drop_missing only observed readings stay."""
    out = rows.withColumn("y", cleaned(F.col("y"), None if mask is None else F.col(mask), threshold))
    return out.where("y <> 0") if drop_missing else out


def join_mask(rows: DataFrame, masks: DataFrame, keys: list[str], name: str = "mask") -> DataFrame:
    """Rows with the data mask of their observation and cell; a reading that no mask covers is masked out."""
    return rows.join(masks.select(*keys, F.col(name)), keys, "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))


def within(rows: DataFrame, analysis_mask: DataFrame, check: bool = False) -> DataFrame:
    """Only the cells whose analysis mask is 1, pushed below any aggregate; check refuses masks that are not 0 or 1."""
    if check and analysis_mask.where("mask NOT IN (0, 1) OR mask IS NULL").limit(1).count():
        raise ValueError("the analysis mask has values other than 0 and 1")
    return rows.join(analysis_mask.where("mask = 1").select("cell"), "cell", "left_semi")


def outside(rows: DataFrame, analysis_mask: DataFrame) -> DataFrame:
    return rows.join(analysis_mask.where("mask = 1").select("cell"), "cell", "left_anti")


def attach_design(rows: DataFrame, design: DataFrame, on: str = "obs", most_bytes: int = 64 << 20) -> DataFrame:
    """Rows joined to the shared design; the design is broadcast while its numbers take at most ``most_bytes``."""
    most_rows = most_bytes // (8 * len(design.columns))
    small = design.limit(most_rows + 1).count() <= most_rows
    return rows.join(F.broadcast(design) if small else design, on)
