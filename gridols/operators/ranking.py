"""Row numbers and equal blocks over a whole table, without bringing it to one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridols.sources.folders import kept

#: Bits of ``monotonically_increasing_id`` that count within a partition.
WITHIN = 33


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Rows with their place, from 1, in ascending order of a distinct key.

    The rows are dealt out by ranges of the key, sorted and written once with their place in their range; only the ranges'
    counts, one for each partition, meet in one place.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("place", F.monotonically_increasing_id()), "numbered")
    within = F.col("place") % (1 << WITHIN)
    ranged = placed.withColumn("range", F.shiftright("place", WITHIN))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each partition
    return ranged.join(F.broadcast(base), "range").withColumn(name, (F.col("base") + within + 1).cast("long")).drop("range", "place", "base")


def blocks(rows: DataFrame, key: str, k: int, name: str = "block") -> DataFrame:
    """Rows with their contiguous block, from 0; sizes are at most one apart, the larger blocks first."""
    ranked = numbered(rows, key, "number")
    total = F.broadcast(ranked.agg(F.count("*").alias("total")))
    r, q, rest = F.col("number") - 1, F.floor(F.col("total") / k), F.col("total") % k
    wide = (q + 1) * rest
    block = F.when(r < wide, F.floor(r / (q + 1))).otherwise(rest + F.floor((r - wide) / F.greatest(q, F.lit(1))))
    return ranked.join(total).withColumn(name, block.cast("int")).drop("number", "total")
