"""What the training-data operators share: where intermediate tables go, and how inputs are narrowed."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and all runs in one process (tests, local mode) is a temporary folder chosen and
    set; a cluster without a named folder is refused, since its executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. folders: columns by whose values the files are laid out."""
    path = f"{shared_dir(df.sparkSession)}/gridols-{name}-{uuid.uuid4().hex}"
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)  # it goes with the application
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column is read or can clash; rows without a doc_id are left out."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is none of ids.doc_id, whatever their other columns are called."""
    name = unused("gone", documents.columns)
    gone = ids.select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, documents["doc_id"] == gone[name], "left_anti")


def fold(modulus: int):
    """The remainder that tells held-out documents from the others: crc32 of the id's decimal digits."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus)


def hashed_sample(rows: DataFrame, group: str, n: int, salts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """Of each group the n rows with the smallest hash of doc_id; after the first cut no window ranks more than ``8 * n`` rows."""
    cut = rows.withColumn("h", F.xxhash64("doc_id"))
    for few in (*salts, 1):
        ranked = Window.partitionBy(group, F.pmod("h", F.lit(few))).orderBy("h", "doc_id")
        cut = cut.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= n).drop("r")
    return cut.select(*rows.columns)
