"""Maps and product forms kept in storage: maps updated in place by block, forms looked up by key without a shuffle."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.operators.products import add_forms
from gridols.sources.folders import delete, qualified, read_text, write_text

KEYS = ["map", "vol", "part"]
#: Cells of a stored range, and ranges of a volume up to which they may be narrower.
WIDTH, NARROW = 1 << 20, 64


def part_of(width: int) -> Column:
    return F.floor(F.col("cell") / width).cast("long")


def layout(spark: SparkSession, path: str) -> str:
    """The full address of the small file that tells how a table of maps is laid out."""
    return next(qualified(spark, [f"{path}/_layout.json"]))


def save_maps(maps: DataFrame, path: str, width: int = WIDTH) -> None:
    """Maps (map, vol, cell, value) as Parquet, laid out by map, volume and range of ``width`` cells; replaces what was there.

    A range is a folder with a file of its own. Where ``width`` would make more than ``NARROW`` ranges of a volume they are
    widened, to ``WIDTH`` cells at most, so that the files do not grow in number with the cells while they hold next to nothing.
    """
    first, last = maps.agg(F.min("cell"), F.max("cell")).first()
    width = width if first is None else max(width, min(WIDTH, -(-(last - first + 1) // NARROW)))
    dealt = maps.select("map", "vol", "cell", "value", part_of(width).alias("part"))
    dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "cell").write.mode("overwrite").partitionBy(*KEYS).parquet(path)
    write_text(layout(maps.sparkSession, path), json.dumps({"width": width}))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(map, vol, cell, value) of stored maps; conditions on map and vol choose folders, those on cell choose row groups."""
    kinds = "cell long, value double, map string, vol int, part long"
    return spark.read.schema(kinds).parquet(path).select("map", "vol", "cell", "value")


def upsert_stored(block: DataFrame, path: str) -> None:
    """Put a block's values (map, vol, cell, value) into stored maps; other cells keep theirs.

    Only the ranges that the block touches are read and written anew; the files of all others stay as they are. What is to
    be written is first staged beside the table, so the block may be computed from it, and a job that fails before the last
    step changes nothing; the last step replaces whole ranges by Spark's own commit. A cell with two values in the block is
    refused. Jobs that write at the same time must not touch the same ranges.
    """
    spark = block.sparkSession
    width = json.loads(read_text(layout(spark, path)))["width"]
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        new = block.select("map", F.col("vol").cast("int").alias("vol"), F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value"), part_of(width).alias("part"))
        new.write.parquet(f"{staging}/block")
        staged = spark.read.parquet(f"{staging}/block")
        if staged.groupBy("map", "vol", "cell").count().where("count > 1").limit(1).count():
            raise ValueError("the block has more than one value of a cell")
        old = spark.read.schema("cell long, value double, map string, vol int, part long").parquet(path)
        touched = staged.select(*KEYS).distinct()  # a row for each range
        rest = old.join(touched, KEYS, "left_semi").join(staged.select("map", "vol", "cell"), ["map", "vol", "cell"], "left_anti")
        columns = ["cell", "value", *KEYS]
        rest.select(*columns).unionByName(staged.select(*columns)).write.parquet(f"{staging}/merged")
        merged = spark.read.parquet(f"{staging}/merged")
        merged.repartition(*KEYS).sortWithinPartitions(*KEYS, "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    finally:
        delete(spark, staging)


def save_forms(forms: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Product forms of batches (batch, cell, n_rows, n, xtx, xty, yty) as a table bucketed by cell and sorted by cell and batch."""
    spark = forms.sparkSession
    dealt = forms.repartition(buckets, "cell").sortWithinPartitions("cell", "batch")  # one file a bucket
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "cell").sortBy("cell", "batch").saveAsTable(table)
    return spark.table(table)


def save_keys(cells: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Cells to look up, as a table in the same buckets."""
    dealt = cells.select("cell").distinct().repartition(buckets, "cell").sortWithinPartitions("cell")
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "cell").sortBy("cell").saveAsTable(table)
    return cells.sparkSession.table(table)


def look_up(stored: DataFrame, cells: DataFrame | tuple[int, int], p: int) -> DataFrame:
    """The forms of some cells, added over the batches: cells in a table of the same buckets, or a range (first, last).

    Neither moves a row between tasks: buckets meet buckets, and sums are taken within them. Conditions on cell reach the
    scan, which skips the row groups that lie outside.
    """
    some = stored.where(F.col("cell").between(*cells)) if isinstance(cells, tuple) else stored.join(cells.hint("shuffle_hash"), "cell", "left_semi")
    return add_forms(some, p)
