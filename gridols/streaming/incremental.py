"""Product forms of a stream of readings: sums only ever grow, so each batch updates the cells that it has readings of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridols.operators.fit import fit
from gridols.operators.products import packed, product_sums
from gridols.sources.folders import written

BASE = "base-"


def stream_forms(readings: DataFrame, xs: list[str]) -> DataFrame:
    """Running product forms by cell of a streaming DataFrame (cell, y, design columns), for update or complete mode."""
    return packed(readings.groupBy("cell").agg(*product_sums(xs)), ["cell"], len(xs))


def start_fit(readings: DataFrame, xs: list[str], sink: str, checkpoint: str, every: int = 20) -> StreamingQuery:
    """Keeps the newest estimates of every cell as Parquet under ``sink``: a batch holds the cells that it changed.

    After ``every`` batches all cells' newest estimates are written together, so that readers need not go further back.
    """

    def write(forms: DataFrame, number: int) -> None:
        fit(forms, len(xs)).write.mode("overwrite").parquet(f"{sink}/{number}")
        if number % every == every - 1:
            compact(forms.sparkSession, sink)

    return stream_forms(readings, xs).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def parts(spark: SparkSession, sink: str) -> tuple[int, list[int]]:
    """(batch up to which the newest base goes, -1 if there is none; the batches after it), of those wholly written."""
    names = written(spark, sink)
    base = max((int(n.removeprefix(BASE)) for n in names if n.startswith(BASE)), default=-1)
    return base, sorted(int(n) for n in names if n.isdigit() and int(n) > base)


def compact(spark: SparkSession, sink: str) -> None:
    """Writes a new base if there are batches after the last one. Older folders stay, since a reader may still use them."""
    _, after = parts(spark, sink)
    if after:
        latest(spark, sink).write.mode("overwrite").parquet(f"{sink}/{BASE}{after[-1]}")


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """Of every cell the estimates of its last batch, from the newest base and the batches after it."""
    base, after = parts(spark, sink)
    names = [f"{BASE}{base}"] * (base >= 0) + [str(k) for k in after]
    if not names:
        raise ValueError(f"no batch is written in {sink}")
    rows = spark.read.parquet(*(f"{sink}/{n}" for n in names))
    batch = F.regexp_extract(F.input_file_name(), rf"/(?:{BASE})?(\d+)/[^/]*$", 1).cast("long")
    told = rows.select("cell", batch.alias("batch"), F.struct(*rows.columns).alias("row"))
    return told.groupBy("cell").agg(F.max_by("row", "batch").alias("newest")).select("newest.*")
