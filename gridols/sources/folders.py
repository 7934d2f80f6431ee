"""Files and folders by address: the shared folder of a cluster, and small files that the driver reads and writes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; a temporary one only where all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where, place = hadoop(spark, folder)
    where.deleteOnExit(place)  # goes with the application
    return folder


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers and writers see an address."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, folder: str) -> None:
    where, place = hadoop(spark, folder)
    where.delete(place, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new shared folder and read back, so that they are computed once and stay the same."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def qualified(spark: SparkSession, paths: list[str]) -> Iterator[str]:
    """The full addresses of files, as Spark's readers name them; each folder is looked up once."""
    known: dict[str, str] = {}
    for p in paths:
        folder = p.rpartition("/")[0] or ("/" if p.startswith("/") else ".")
        if folder not in known:
            where, place = hadoop(spark, folder)
            known[folder] = where.makeQualified(place).toString().rstrip("/")
        yield f"{known[folder]}/{p.rpartition('/')[2]}"


def written(spark: SparkSession, folder: str) -> list[str]:
    """The names of the tables in a folder whose writing is complete."""
    where, place = hadoop(spark, folder)
    inside = [f.getPath() for f in where.listStatus(place) if f.isDirectory()]
    return [p.getName() for p in inside if where.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def file_system(path: str):
    """(file system, path in it) of an address; one without a scheme is a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))


def read_text(path: str) -> str:
    where, name = file_system(path)
    with where.open_input_stream(name, compression=None) as f:
        return f.read().decode("utf-8")


def write_text(path: str, text: str) -> None:
    where, name = file_system(path)
    where.create_dir(name.rpartition("/")[0] or ".")
    with where.open_output_stream(name, compression=None) as f:
        f.write(text.encode("utf-8"))
