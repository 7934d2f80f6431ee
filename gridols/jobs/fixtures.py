"""The given tables as mass-univariate inputs; every one reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.operators.clean import attach_design, clean, cleaned
from gridols.sources.observations import design, from_arrays, from_rows

THRESHOLD = -0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_design(spark, sf_dir) -> DataFrame:
    """One design for all cells: an intercept and the label."""
    return design(table(spark, sf_dir, "embeddings"), "vec_id", [F.lit(1.0), F.col("label")])


def embeddings(spark, sf_dir, threshold: float | None = THRESHOLD) -> DataFrame:
    """(obs, cell, y, x0, x1): the cell is the place in the vector, the observation the vector."""
    readings = clean(from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), threshold=threshold)
    return attach_design(readings, embedding_design(spark, sf_dir))


def masked_embeddings(spark, sf_dir) -> DataFrame:
    """As above, times a data mask that is 0 at every seventh of vec_id plus place."""
    readings = from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("mask", ((F.col("obs") + F.col("cell")) % 7 != 0).cast("int"))
    return attach_design(clean(readings, mask="mask").drop("mask"), embedding_design(spark, sf_dir))


def supplier_lines(spark, sf_dir) -> DataFrame:
    """(cell, y, x0, x1, x2): the supplier's order lines; price on quantity and discount; untaxed lines are missing."""
    y = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    return clean(from_rows(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), y, [F.lit(1.0), F.col("l_quantity"), F.col("l_discount")]))


def part_lines(spark, sf_dir) -> DataFrame:
    """(cell, y, x0, x1, x2, x3): the part's order lines; price on quantity, discount and tax."""
    return clean(from_rows(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_extendedprice"), [F.lit(1.0), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]))


def user_events(spark, sf_dir, threshold: float = 5.0) -> DataFrame:
    """(cell, y, x0, x1, x2): the user's events; value on the hour and on being a purchase; small values are missing."""
    return clean(from_rows(table(spark, sf_dir, "events"), F.col("user_id"), F.col("value"), [F.lit(1.0), F.hour("ts"), (F.col("event_type") == "purchase").cast("int")]), threshold=threshold)


def nation_customers(spark, sf_dir) -> DataFrame:
    """(cell, y, x0 ... x4): the nation's customers; balance on market segment dummies."""
    segment = lambda s: (F.col("c_mktsegment") == s).cast("int")
    return clean(from_rows(table(spark, sf_dir, "customer"), F.col("c_nationkey"), F.col("c_acctbal"), [F.lit(1.0), *map(segment, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"))]))


def strange_values(spark, sf_dir) -> DataFrame:
    """Order lines' discounts with NaN, infinities and nulls put in by line number."""
    y = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).when(F.col("l_linenumber") == 3, -float("inf")).when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("cell"), cleaned(y).alias("y"))


def active_users(spark, sf_dir) -> DataFrame:
    """(cell, mask): 1 for users with a purchase of more than 100."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell")).agg(F.max(((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int")).alias("mask"))
