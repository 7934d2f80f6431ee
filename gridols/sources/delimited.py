"""Numeric matrices from delimited text, with column headers and row names told apart from data by the first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.sources.folders import read_text


def is_number(text: str | None) -> bool:
    try:
        float(text)
        return True
    except (TypeError, ValueError):
        return False


def sniff(rows: list[list[str | None]]) -> tuple[bool, bool]:
    """(first row is a header, first column is row names) of the first two rows."""
    if not rows:
        return False, False
    first, second = rows[0], rows[1] if len(rows) > 1 else None
    blank = lambda x: x is None or x == "" or x.lower() == "nan"
    word = lambda x: not blank(x) and not is_number(x)
    if len(first) == 1:
        return word(first[0]), False
    if second is None:
        return False, word(first[0]) or blank(first[0])
    if blank(first[0]):
        return True, word(second[0]) or is_number(second[0]) and word(first[1])
    if word(first[0]) and word(first[1]):
        return True, word(second[0])
    return False, word(second[0])


def read_matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(row, x0, x1, ...): data rows in file order, as doubles."""
    raw = spark.read.csv(path, header=False, sep=separator, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    header, names = sniff([list(r) for r in raw.limit(2).collect()])
    cols = raw.columns[1:] if names else raw.columns
    numbered = raw.withColumn("row", F.monotonically_increasing_id())  # ascending in file order
    if header:
        least = numbered.agg(F.min("row")).first()[0]
        numbered = numbered.where(F.col("row") != least)
    return numbered.select("row", *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)))


def read_paths(path: str) -> list[str]:
    """The paths that a text file lists; their order is that of the observations."""
    return [line for line in read_text(path).splitlines() if line.strip()]
