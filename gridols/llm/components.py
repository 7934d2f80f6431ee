"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Each round is two grouped minima and one join; hubs are summed before the shuffle and their join is one that Spark
splits when a key is hot. Links stay distributed. Every round is written to the shared folder, so lineage stays short.

Nulls and the like: a link with a null end, or from a node to itself, joins nothing; repeated links and both directions of
one count once; nodes without a link have no row; columns other than a and b are not read; no links give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize


def state_of(links: DataFrame) -> tuple:
    """What tells two sets of distinct links (u, v) apart: their number and two exclusive-ors of hashes, which cannot overflow."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable. edges: (a, b) long."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    state = None
    while True:
        now = state_of(links)
        if now == state or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m")), "least")
        large = both.where("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
