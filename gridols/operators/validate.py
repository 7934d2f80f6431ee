"""Checks of inputs before a fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geometry(meta: DataFrame) -> None:
    """All images have one shape and one affine; meta: (path, shape, affine)."""
    kinds = meta.groupBy("shape", "affine").agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy(F.desc("n"), "path").limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"{kinds[1]['path']} differs in shape or affine from {kinds[0]['path']}")


def mask_count(responses: int, masks: int) -> None:
    if masks and masks != responses:
        raise ValueError(f"{masks} data masks for {responses} responses: each response needs one, or there are none")


def rows_match(responses: int, design_rows: int) -> None:
    if responses != design_rows:
        raise ValueError(f"{responses} responses but {design_rows} rows of the design")


def unique_readings(rows: DataFrame) -> None:
    """No observation has two readings of a cell."""
    if rows.groupBy("obs", "cell").count().where("count > 1").limit(1).count():
        raise ValueError("an observation has more than one reading of a cell")


def study_faults(studies: DataFrame) -> DataFrame:
    """(study, faults) of a table of studies, one row each: which of the checks refuse it, in alphabetical order.

    studies: (study, responses, design_rows, masks, width, min_percent, contrast array of rows). contrast_rank is the rank of
    the contrast's rows, told only where their width is right.
    """
    fault = lambda name, wrong: F.when(F.coalesce(wrong, F.lit(True)), F.lit(name))
    told = [
        fault("contrast_rank", F.col("rank") < F.size("contrast")), fault("contrast_width", ~F.forall("contrast", lambda r: F.size(r) == F.col("width"))), fault("design_rows", F.col("responses") != F.col("design_rows")),
        fault("mask_count", (F.col("masks") != 0) & (F.col("masks") != F.col("responses"))), fault("min_percent", ~F.col("min_percent").between(0, 1)),
    ]

    def ranks(batches):
        for b in batches:
            names = b.schema.names
            rank = [np.linalg.matrix_rank(np.array(c)) if c and len({len(r) for r in c}) == 1 else len(c or []) for c in b.column(names.index("contrast")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int32())], [*names, "rank"])

    columns = studies.select("study", "responses", "design_rows", "masks", "width", "min_percent", F.col("contrast").cast("array<array<double>>").alias("contrast"))
    ranked = columns.mapInArrow(ranks, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema) + ", rank int")
    return ranked.select("study", F.array_compact(F.array(*told)).alias("faults"))


def design_summary(design: DataFrame, xs: list[str]) -> DataFrame:
    """Rows, non-finite values and distinct values of each design column."""
    told = [F.struct(F.lit(x).alias("column"), F.count("*").alias("n_rows"), F.count_if(F.col(x).isNull() | F.isnan(x)).alias("n_bad"), F.count_distinct(x).alias("n_distinct"), F.min(x).alias("least"), F.max(x).alias("largest")).alias(f"s{k}") for k, x in enumerate(xs)]
    return design.agg(*told).select(F.explode(F.array(*(F.col(f"s{k}") for k in range(len(xs))))).alias("s")).select("s.*")
