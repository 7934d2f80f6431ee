"""How far two maps are apart."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, by: list[str], value: str = "value", groups: list[str] | None = None) -> DataFrame:
    """Mean absolute error and mean relative difference 2 |(a - b) / (a + b)| where both have a value and b's is not 0."""
    both = a.select(*by, *(groups or []), F.col(value).alias("a")).join(b.select(*by, F.col(value).alias("b")), by).where("b <> 0")
    gap = F.abs(F.col("a") - F.col("b"))
    relative = F.when(gap == 0, F.lit(0.0)).otherwise(2 * F.abs(F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b"))))
    return both.groupBy(*(groups or [])).agg(F.count("*").alias("n_compared"), F.avg(gap).alias("mae"), F.avg(relative).alias("mrd"))
