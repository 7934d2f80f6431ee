"""Which cells are analysed: counts, degrees of freedom, the missingness rules, the analysis mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridols.operators.products import both_all


def edf(p: int) -> Column:
    """Degrees of freedom of a cell, never below 0."""
    return F.greatest(F.col("n") - F.lit(p), F.lit(0)).cast("long")


def rules(p: int, total: Column | int, min_percent: float | None = None, min_n: int | None = None) -> Column:
    """Enough readings: each rule that is given, and in any case more than p + 1."""
    total = F.lit(total) if isinstance(total, int) else total
    given = [F.col("n") > F.lit(p + 1)]
    given += [] if min_percent is None else [F.col("n") >= F.lit(min_percent) * total]
    given += [] if min_n is None else [F.col("n") >= F.lit(min_n)]
    return both_all(given)


def count_maps(forms: DataFrame, p: int, total: Column | int, min_percent=None, min_n=None, analysis_mask: DataFrame | None = None) -> DataFrame:
    """(cell, n, edf, mask): n and edf of every cell, also of those that the mask leaves out."""
    told = forms.select("cell", "n", edf(p).alias("edf"), rules(p, total, min_percent, min_n).alias("enough"))
    if analysis_mask is None:
        return told.select("cell", "n", "edf", F.col("enough").cast("int").alias("mask"))
    inside = analysis_mask.where("mask = 1").select("cell", F.lit(True).alias("inside"))
    return told.join(inside, "cell", "left").select("cell", "n", "edf", (F.col("enough") & F.coalesce("inside", F.lit(False))).cast("int").alias("mask"))


def analysed(forms: DataFrame, p: int, total: Column | int, min_percent=None, min_n=None, analysis_mask: DataFrame | None = None) -> DataFrame:
    kept = forms.where(rules(p, total, min_percent, min_n))
    return kept if analysis_mask is None else kept.join(analysis_mask.where("mask = 1").select("cell"), "cell", "left_semi")
