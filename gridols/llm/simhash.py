"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance, then components.

Fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most ``DISTANCE`` bits agree on at least
``BLOCKS - DISTANCE`` of them, so they share a bucket in the table of those blocks. Equal fingerprints are merged
before anything is joined. A bucket is searched breadth-first over the fingerprints not reached yet: that gives its
components without listing its pairs. In a bucket of over ``chunk`` fingerprints the same is done once more: its pairs
differ only in the bits that the bucket leaves free, so these are cut into blocks in turn, of which close pairs agree on
some, and the smaller buckets of those blocks are searched instead, down to ``LEVELS`` times. Fingerprints that are close in
all of that are few: only where more than ``chunk`` share all but the last few bits is the bucket split in chunks, and each
pair of chunks searched by itself. Nothing of this loses a link.

A task holds one bucket, or pair of parts, and one batch at a time.

Nulls and the like: a null text has no words, like an empty one, and gets fingerprint zero, which links as any other;
a bit set in exactly half of the hashes is 0; rows without a doc_id are left out of ``near_duplicates`` and kept by
``keep_one``; repeated rows get a row each; long texts are hashed whole, a piece of their shingles at a time; columns other
than doc_id and text are not read, and ``keep_one`` keeps columns of any name; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize, texts, without
from gridols.llm.components import components

BLOCKS = 6
DISTANCE = 4
#: Times that a crowded bucket's free bits are cut into blocks; bits that are too few to be cut again.
LEVELS, FEWEST = 3, 12


def fingerprint(text: bytes | None, width: int = 4, piece: int = 1 << 16) -> int:
    """64 majority bits over the XXH64 hashes of the word shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    joined = b" ".join(words)
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), piece):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + piece], ends[at : at + piece])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(documents).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """As signed longs, the bits that each table's buckets agree on."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [(m - (1 << 64)) if (m := sum(c)) >> 63 else m for c in combinations(each, blocks - distance)]


def bucket_links(fp: np.ndarray, rep: np.ndarray, group: np.ndarray, distance: int, pairwise: int = 8):
    """Links (a, b) that connect each group's members as far as they are within ``distance``; rows come by group."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    own = np.repeat(size, size)
    left, right = [], []
    for d in range(1, pairwise):
        i = np.flatnonzero((group[:-d] == group[d:]) & (own[:-d] <= pairwise)) if len(group) > d else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        left.append(rep[i])
        right.append(rep[i + d])
    for at, n in zip(first[size > pairwise], size[size > pairwise]):
        f, r = fp[at : at + n], rep[at : at + n]
        rest = np.arange(n)
        while len(rest) > 1:
            todo, rest, root = [rest[0]], rest[1:], r[rest[0]]
            while todo and len(rest):
                near = np.bitwise_count(f[rest] ^ f[todo.pop()]) <= distance
                found, rest = rest[near], rest[~near]
                todo += found.tolist()
                left.append(np.full(len(found), root))
                right.append(r[found])
    return (np.concatenate(left), np.concatenate(right)) if left else (rep[:0], rep[:0])


def finer(mask: int, blocks: int, distance: int) -> list[int]:
    """As signed longs, the masks of a bucket's smaller buckets: its own bits, and all but ``distance`` blocks of those that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    if len(free) < FEWEST:
        return [mask]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [(m - (1 << 64)) if (m := mask % (1 << 64) | sum(c)) >> 63 else m for c in combinations(each, blocks - distance)]


def near_links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = 4096) -> DataFrame:
    """(a, b) between representatives whose fingerprints are connected within a bucket. distinct: (fp, rep)."""
    tables = masks(blocks, distance)
    in_tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(tables)))
    rows = distinct.withColumn("k", F.explode(in_tables)).select("k.t", "k.bucket", "fp", "rep")
    done = []
    for _ in range(LEVELS):
        crowded = materialize(rows.groupBy(F.col("t").alias("c_t"), F.col("bucket").alias("c_bucket")).agg(F.count("*").alias("n")).where(F.col("n") > chunk), "crowded")
        if not crowded.limit(1).count():
            break
        at = (rows["t"] == crowded["c_t"]) & (rows["bucket"] == crowded["c_bucket"])
        done.append(bucket_rows_links(rows.join(crowded, at, "left_anti"), distance, chunk))
        finest = [(t, m) for t, mask in enumerate(tables) for m in finer(mask % (1 << 64), blocks, distance)]
        split = [(t, new, m) for new, (t, m) in enumerate(finest)]
        known = distinct.sparkSession.createDataFrame(split, "of int, t int, mask long")  # tables of tables: 225, then 3,375
        heavy = rows.join(crowded, at, "left_semi").withColumnRenamed("t", "of").drop("bucket")
        rows = materialize(heavy.join(F.broadcast(known), "of").select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp", "rep"), "finer")
        tables = [m for _, _, m in split]
    links = bucket_rows_links(rows, distance, chunk)
    for more in done:
        links = links.unionByName(more)
    return links


def bucket_rows_links(rows: DataFrame, distance: int, chunk: int) -> DataFrame:
    """(a, b) between representatives that are connected within a bucket. rows: (t, bucket, fp, rep), t being the table."""
    crowded = materialize(rows.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "crowded")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(chunk)).cast("int")
    dealt = (
        rows.join(crowded, ["t", "bucket"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - F.lit(1))))
        .select("t", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp", "rep")
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(cols):
        a, b = bucket_links(cols[4].view(np.uint64), cols[5], np.cumsum(starts(cols)), distance)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def starts(cols):
        return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])) if len(cols[0]) else np.zeros(0, bool)

    def run(batches):  # groups come one after another; the last one of a batch waits for the rest of its rows
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            last = int(np.flatnonzero(starts(cols))[-1]) if len(cols[0]) else 0
            if last:
                yield links([np.ascontiguousarray(c[:last]) for c in cols])
            held = [np.ascontiguousarray(c[last:]) for c in cols]
        if held is not None and len(held[0]):
            yield links(held)

    keys = ["t", "bucket", "lo", "hi"]
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 4, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(documents, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = components(near_links(distinct, blocks, distance, chunk))
    named = materialize(
        distinct.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("fp").alias("own"), F.coalesce("component", "rep").alias("component_id")), "named"
    )
    return prints.join(named, F.col("fp") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, **how) -> DataFrame:
    """The documents without those that a smaller doc_id is near to; of repeated rows of one doc_id all stay."""
    return without(documents, near_duplicates(documents, **how).where("doc_id <> component_id"))
