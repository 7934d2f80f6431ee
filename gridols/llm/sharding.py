"""Sharding by best-fit-decreasing bin packing of indivisible groups (documents of equal text).

Every group is packed, from large to small, into the bin with the least room that still holds it, found in a balanced
tree. Groups of equal size enter together: the packing runs over (size, how many) pairs, which come to the driver, and
gives the same bins as one group at a time. Sizes of more than ``bits`` binary digits count as the next size of so many
digits (at most 1 part in 4096 more), so there are at most 2**(bits - 1) pairs for each doubling of the size, whatever
the input. Only the few groups over 1 / (``shards * grain``) of all bytes go by their exact size. The capacity is the
smallest, to one part in 2**20, at which best-fit-decreasing needs no more shards than asked for; groups over the fair
share have a shard each before that. Sizes, group sums, the numbering within a size, assignment and slots are Spark's.

Nulls and the like: a null text counts as empty; a null doc_id is an ordinary row (numbered first); repeated rows are
separate rows of one group; of bins with equal room the one made first is taken; groups of equal size are told apart by the
hash of their text; slots follow a hash of the doc_id, then doc_id; a long text is its size alone; columns other than
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridols.llm.common import materialize


class Tree:
    """Balanced (AVL) tree of (remaining, bin): insert, and removal of the least entry not below a key."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n[3] if n else 0

    def _node(self, key, left, right):
        return (key, left, right, 1 + max(self._h(left), self._h(right)))

    def _join(self, key, left, right):
        if self._h(left) > self._h(right) + 1:
            k, a, b, _ = left
            if self._h(a) >= self._h(b):
                return self._node(k, a, self._node(key, b, right))
            return self._node(b[0], self._node(k, a, b[1]), self._node(key, b[2], right))
        if self._h(right) > self._h(left) + 1:
            k, a, b, _ = right
            if self._h(b) >= self._h(a):
                return self._node(k, self._node(key, left, a), b)
            return self._node(a[0], self._node(key, left, a[1]), self._node(k, a[2], b))
        return self._node(key, left, right)

    def add(self, key):
        def go(n):
            if n is None:
                return self._node(key, None, None)
            return self._join(n[0], go(n[1]), n[2]) if key < n[0] else self._join(n[0], n[1], go(n[2]))

        self.root = go(self.root)

    def pop_at_least(self, key):
        """Remove and return the least entry >= key, or None."""
        best, n = None, self.root
        while n:
            best, n = (n[0], n[1]) if n[0] >= key else (best, n[2])
        if best is not None:
            self.root = self._without(self.root, best)
        return best

    def _without(self, n, key):
        if key < n[0]:
            return self._join(n[0], self._without(n[1], key), n[2])
        if key > n[0]:
            return self._join(n[0], n[1], self._without(n[2], key))
        if n[1] is None or n[2] is None:
            return n[1] or n[2]
        least = n[2]
        while least[1]:
            least = least[1]
        return self._join(least[0], n[1], self._without(n[2], least[0]))


def best_fit_decreasing(pairs: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """((place of the pair, bin, how many) in order, bins used); pairs are (size, count) with sizes from large to small.

    Items over the capacity get a bin each.
    """
    tree, runs, made = Tree(), [], 0
    for k, (size, count) in enumerate(pairs):
        while count:
            found = tree.pop_at_least((size, -1))
            if found is None:
                found, made = (max(capacity, size), made), made + 1
            room, home = found
            n = min(count, room // size)  # the tightest bin stays the tightest while it holds another
            runs.append((k, home, n))
            tree.add((room - n * size, home))
            count -= n
    return runs, made


def pack_into(pairs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(place of the pair, bin, how many) of best-fit-decreasing at the smallest capacity that needs at most ``shards`` bins.

    An item over the fair share of what is left gets a bin of its own first, so that it does not set the others' capacity.
    """
    left, rest, own, runs = [n for _, n in pairs], sum(s * n for s, n in pairs), 0, []
    first = 0
    while first < len(pairs) and pairs[first][0] * (shards - own) > rest:
        runs.append((first, own, 1))
        rest, own, left[first] = rest - pairs[first][0], own + 1, left[first] - 1
        first += not left[first]
    others = [(s, n) for (s, _), n in zip(pairs[first:], left[first:], strict=True)]
    if not others:
        return runs
    low = -(-rest // (shards - own))
    high, best = 2 * low, None
    while best is None or best[1] > shards - own:
        best, high = best_fit_decreasing(others, high), 2 * high
    high //= 2
    while high - low > max(1, low >> 20):
        mid = (low + high) // 2
        tried = best_fit_decreasing(others, mid)
        if tried[1] <= shards - own:
            best, high = tried, mid
        else:
            low = mid
    tried = best_fit_decreasing(others, low)
    best = tried if tried[1] <= shards - own else best
    return runs + [(first + k, own + b, n) for k, b, n in best[0]]


def shard(documents: DataFrame, shards: int = 24, grain: int = 256, bits: int = 13, blocks: int = 1024) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key")
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * F.lit(shards * grain) >= F.lit(total)  # at most shards * grain groups
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin("size")) - F.lit(bits), F.lit(0)))
    classed = groups.withColumn("class", F.when(large, F.col("size")).otherwise(F.ceil(F.col("size") / step) * step).cast("long"))
    pairs = sorted(((r[0], r[1]) for r in classed.groupBy("class").agg(F.count("*")).collect()), reverse=True)
    runs, at = [], [0] * len(pairs)
    for k, home, n in pack_into(pairs, shards):
        runs.append((pairs[k][0], at[k], at[k] + n, home))
        at[k] += n
    place = spark.createDataFrame(runs, "class long, lo long, hi long, shard int")
    # the number of each group within its class: by blocks of keys, so that no class is numbered in one task
    cut = classed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    tally = cut.groupBy("class", "block").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("class", "block").orderBy("key")) - F.lit(1)
    numbered = cut.withColumn("number", number).join(tally.select("class", "block", earlier.alias("base")), ["class", "block"])
    mine = F.col("base") + F.col("number")
    homes = materialize(numbered.join(F.broadcast(place), "class").where((mine >= F.col("lo")) & (mine < F.col("hi"))).select("key", "size", "shard"), "shard-homes")
    hot = homes.where(large).select("key", F.col("shard").alias("own"))
    rest = rows.join(F.broadcast(hot), "key", "left")
    known = rest.where("own IS NOT NULL").select("doc_id", "size", "text_crc32", F.col("own").alias("shard"))
    other = rest.where("own IS NULL").select("doc_id", "size", "text_crc32", "key").join(homes.where(~large).select("key", "shard"), "key").drop("key")
    placed = known.unionByName(other).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))  # at most shards * blocks rows
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - F.lit(1)
    return (
        placed.withColumn("within", within).join(F.broadcast(base), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
