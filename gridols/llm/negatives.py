"""Hard negatives by exact search over rotated one-bit codes.

Every vector is coded in ``LEVELS`` steps, each behind a fixed random rotation of its own: the code of a step is the signs of
what the steps before left over, a unit vector of the directions +-1/sqrt(D); stored with it is its alignment, the inner
product of the left-over with that unit vector, and at the end the length of what is still left, about 0.6 times less a
step. An anchor's rotated vector is cut to eight bit planes. Its inner product with a code is then a sum of popcounts, and
alignments times these give an estimate of the score. What the estimate leaves out is the inner product of the anchor with
the last left-over and of the planes' rounding errors with the codes, so by Cauchy-Schwarz the score is at most the products
of these lengths away: an interval that always holds the score. Only pairs whose interval reaches what is wanted are scored, with whole numbers.

Two passes. In the first an anchor meets the blocks of its own label and keeps its best rows, the positives. In the second
it meets all other blocks and keeps, for each positive, the best rows in that positive's range of scores. A pass deals
blocks and packs of anchors out on a grid: a block goes to ``columns`` cells and a pack to ``rows`` cells, which are chosen so
that both sides move about the same number of bytes. A label may hold any share of the rows, since blocks are cut by
number. A cell keeps the lists of its anchors, at most ``CELL`` of them; these meet in a window of a list for each cell. All
joins are sort-merge joins: both sides grow with the table, so neither goes through the driver.

Nulls and the like: rows without an id or label, with a null vector or with a null, NaN or infinite component take no part;
vectors of different lengths meet as if the shorter ended in zeros, and an empty one scores 0; repeated ids are separate
rows, but an anchor never meets a row of its own id, and anchors that share an id have a list each; ties go to the smaller
id; a positive of negative score has no range and so no negatives; an anchor without positives has no rows; scores must
stay below 2**53, larger ones raise an error; columns other than vec_id, embedding and label are not read; empty tables
give an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridols.llm.common import materialize
from gridols.llm.topk import dense, merge, to_bytes, to_matrix

LEVELS, PLANES = 6, 8
#: Anchors that a task compares with a block at a time, and those whose lists a cell keeps.
SLICE, CELL = 64, 1 << 16
SEED = 11
BLOCK = "block long, label int, n int, asks int, ids binary, rows binary, bits binary, along binary, rest binary, size binary"
PACK = "pack long, q_label int, q_n int, q_ids binary, q_rows binary"
WANTED = 2**53


@cache
def rotation(dim: int, step: int) -> np.ndarray:
    """A fixed orthogonal matrix for each step; the same in every task."""
    return np.linalg.qr(np.random.default_rng(SEED + step).normal(size=(dim, dim)))[0]


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """The last axis, a multiple of 64 long, as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))).astype(float)


def coded(vectors: np.ndarray, dim: int):
    """(bits (n, LEVELS, words), alignments (n, LEVELS), length of what is left, length) of each vector."""
    left = widened(vectors, dim)
    size, bits, along = np.linalg.norm(left, axis=1), [], []
    for k in range(LEVELS):
        left = left @ rotation(dim, k)
        signs = left >= 0
        bits.append(packed_bits(signs))
        along.append(np.abs(left).sum(axis=1) / np.sqrt(dim))
        left -= along[-1][:, None] * np.where(signs, 1.0, -1.0) / np.sqrt(dim)
    return np.stack(bits, axis=1), np.stack(along, axis=1), np.linalg.norm(left, axis=1), size


def intervals(anchors: np.ndarray, bits: np.ndarray, along: np.ndarray, rest: np.ndarray, size: np.ndarray, dim: int):
    """(lowest, highest) score of each anchor with each coded vector."""
    q = widened(anchors, dim)
    length = np.linalg.norm(q, axis=1, keepdims=True)
    middle, apart = np.zeros((len(q), len(rest))), length * rest + 1e-9 * (length + 1) * (size + 1)  # the last is for the sums' own rounding
    for k in range(LEVELS):
        q, code = q @ rotation(dim, k), bits[:, k]
        least, step = q.min(axis=1, keepdims=True), np.ptp(q, axis=1, keepdims=True) / (2**PLANES - 1)
        step = np.where(step > 0, step, 1.0)
        level = np.rint((q - least) / step).astype(np.uint8)
        cut = least + step * level
        met = np.zeros(middle.shape, np.uint16 if dim << PLANES <= 1 << 16 else np.uint32)
        both, count = np.empty(middle.shape, np.uint64), np.empty(middle.shape, np.uint8)
        for p in reversed(range(PLANES)):
            plane = packed_bits((level >> p) & 1)
            met += met  # planes from the highest down
            for w in range(code.shape[1]):
                np.bitwise_and(plane[:, w, None], code[None, :, w], out=both)
                met += np.bitwise_count(both, out=count)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        middle += (2 * (least * ones + step * met) - cut.sum(axis=1, keepdims=True)) * (along[:, k] / np.sqrt(dim))
        apart += np.linalg.norm(q - cut, axis=1, keepdims=True) * along[:, k]
    return middle - apart, middle + apart


def exact(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, in whole numbers."""
    dim = min(anchors.shape[1], rows.shape[1])
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("nd,nd->n", anchors[i[part], :dim], rows[j[part], :dim])
    return out


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row the kth largest value, -inf with fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def prepared(vectors: DataFrame, is_anchor, scale: float) -> DataFrame:
    """(vec_id, label, v, asks): the rows that take part, components as floor(scale * x), x as double."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col("embedding").cast("array<double>")
    asks = F.coalesce(is_anchor, F.lit(False))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"), asks.alias("asks"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))
    large = F.lit(float(WANTED))
    whole = F.transform("v", lambda x: F.when(F.abs(x * F.lit(scale)) >= large, F.raise_error(F.lit("a component is 2**53 or more after scaling"))).otherwise(F.floor(x * F.lit(scale))).cast("long"))
    return kept.select("vec_id", "label", whole.alias("v"), "asks")


def in_batches(batches, n: int):
    """Tables of n consecutive rows of one label; the last of a label may be shorter."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        labels = held.column("label").to_numpy()
        cuts = [0, *np.flatnonzero(np.diff(labels)) + 1]
        for lo, hi in zip(cuts, cuts[1:]):
            yield from (held.slice(at, min(n, hi - at)) for at in range(lo, hi, n))
        lo = cuts[-1]
        while len(held) - lo >= n:
            yield held.slice(lo, n)
            lo += n
        held = held.slice(lo).combine_chunks()
    if held is not None and len(held):
        yield held


def sorted_by_label(rows: DataFrame, parts: int) -> DataFrame:
    keys = ["label", "vec_id", F.xxhash64("v")]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def make_blocks(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """Coded blocks of at most ``block`` rows of one label."""

    def run(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        for t in in_batches(batches, block):
            ids, m = t.column("vec_id").to_numpy(), dense(t.column("v").combine_chunks())
            asks = int(t.column("asks").to_numpy().sum())
            held = (ids.astype("<i8").tobytes(), to_bytes(m), *(np.ascontiguousarray(x).tobytes() for x in coded(m, dim)))
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([t.column("label")[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([asks], pa.int32()), *(pa.array([x], pa.binary()) for x in held)], ["block", "label", "n", "asks", "ids", "rows", "bits", "along", "rest", "size"])
            made += 1

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted_by_label(rows, parts).mapInArrow(run, BLOCK)


def make_packs(rows: DataFrame, parts: int, pack: int) -> DataFrame:
    """The anchors in packs of at most ``pack`` of one label."""

    def run(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        for t in in_batches(batches, pack):
            ids = t.column("vec_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([t.column("label")[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([to_bytes(dense(t.column("v").combine_chunks()))], pa.binary())], ["pack", "q_label", "q_n", "q_ids", "q_rows"])
            made += 1

    return sorted_by_label(rows.where("asks"), parts).mapInArrow(run, PACK)


def opened(r: dict):
    """(ids, whole numbers, codes) of a block."""
    n = r["n"]
    codes = np.frombuffer(r["bits"], "<u8").reshape(n, LEVELS, -1), np.frombuffer(r["along"]).reshape(n, LEVELS), np.frombuffer(r["rest"]), np.frombuffer(r["size"])
    return np.frombuffer(r["ids"], "<i8"), to_matrix(r["rows"], n), codes


def checked(q: np.ndarray, rows: np.ndarray) -> None:
    """Scores beyond 2**53 would not be told apart."""
    tops = [max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in (q, rows)]
    if tops[0] * tops[1] * min(q.shape[1], rows.shape[1]) >= WANTED:
        raise ValueError("scores may be 2**53 or more")


class Lists:
    """The k best candidates of each of a pack's searches, for the packs of a cell."""

    def __init__(self, k: int):
        self.k, self.of, self.size = k, {}, 0

    def get(self, pack: int, searches: int):
        if pack not in self.of:
            self.of[pack] = np.full((searches, self.k), -1, np.int64), np.full((searches, self.k), -np.inf)
            self.size += searches
        return self.of[pack]

    def rows(self):
        for pack, (ids, score) in self.of.items():
            at, k = np.nonzero(score > -np.inf)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pack)), pa.array(at.astype(np.int32)), pa.array(ids[at, k]), pa.array(score[at, k].astype(np.int64))], ["pack", "search", "vec_id", "score"])
        self.of, self.size = {}, 0


FOUND = "pack long, search int, vec_id long, score long"


def search(pairs: DataFrame, k: int, dim: int, per_anchor: int, wanted) -> DataFrame:
    """FOUND: of each pack's searches the k best of what each cell has.

    wanted(row, slice, low, high, kth) tells which pairs of the slice's anchors may count; taken(row, i, score) is part of it.
    """

    def run(batches):
        lists = Lists(k)
        for b in batches:
            for r in b.to_pylist():
                qids, q = np.frombuffer(r["q_ids"], "<i8"), to_matrix(r["q_rows"], r["q_n"])
                ids, rows, codes = opened(r)
                checked(q, rows)
                if r["pack"] not in lists.of and lists.size > CELL * per_anchor:
                    yield from lists.rows()
                best = lists.get(r["pack"], len(q) * per_anchor)
                for lo in range(0, len(q), SLICE):
                    part = slice(lo, min(lo + SLICE, len(q)))
                    low, high = intervals(q[part], *codes, dim)
                    own = qids[part][:, None] == ids[None, :]
                    low[own], high[own] = -np.inf, -np.inf
                    i, j, take = wanted(r, part, low, high, best[1])
                    if len(i):
                        score = exact(q[part], rows, i, j)
                        who, which = take(i, score)
                        if len(who):
                            merge(None, *best, who, ids[j[which]], score[which].astype(float), k)
        yield from lists.rows()

    return pairs.mapInArrow(run, FOUND)


def best_of_own_label(k: int):
    def wanted(r, part, low, high, kth):
        floor = np.maximum(kth_largest(low, k), kth[part, -1])
        i, j = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
        return i, j, lambda i, score: (i + part.start, np.arange(len(i)))

    return wanted


def best_in_range(k: int, per_anchor: int, low_share: tuple[int, int], high_share: tuple[int, int]):
    """Of each positive's range: searches are numbered anchor * per_anchor + place of the positive."""

    def wanted(r, part, low, high, kth):
        known = np.frombuffer(r["positive_scores"], "<i8").reshape(-1, per_anchor)[part]
        there = np.frombuffer(r["positive_there"], bool).reshape(-1, per_anchor)[part]
        any_of = np.zeros(low.shape, bool)
        for s in range(per_anchor):
            most, least = np.floor(known[:, s] * high_share[0] / high_share[1]) + 1, np.ceil(known[:, s] * low_share[0] / low_share[1]) - 1
            sure = kth_largest(np.where(high <= most[:, None] - 2, low, -np.inf), k)
            floor = np.maximum(np.maximum(sure, least), kth[np.arange(part.start, part.stop) * per_anchor + s, -1])
            any_of |= there[:, s, None] & (low <= most[:, None]) & (high >= floor[:, None])
        i, j = np.nonzero(any_of & (high > -np.inf))

        def take(i, score):
            p = known[i]
            ok = there[i] & (p * low_share[0] <= score[:, None] * low_share[1]) & (score[:, None] * high_share[1] <= p * high_share[0])
            which, s = np.nonzero(ok)
            return (i[which] + part.start) * per_anchor + s, which

        return i, j, take

    return wanted


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("pack", "search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def on_grid(blocks: DataFrame, packs: DataFrame, rows: int, columns: int, same_label: bool) -> DataFrame:
    """Every pair of a block and a pack of the same label, or of another one, in the cell where they meet."""
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    b = blocks.drop("asks").select("*", F.pmod(F.xxhash64("block"), F.lit(rows)).cast("int").alias("r"), spread("c", columns))
    p = packs.select("*", F.pmod(F.xxhash64("pack"), F.lit(columns)).cast("int").alias("q_c"), spread("q_r", rows))
    at = (b["r"] == p["q_r"]) & (b["c"] == p["q_c"])
    meet = at & (b["label"] == p["q_label"] if same_label else b["label"] != p["q_label"])
    return b.join(p.hint("merge"), meet).drop("r", "c", "q_r", "q_c")  # copies for the grid are not in Spark's estimate: a broadcast would put them all on the driver


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: float = 256.0, block: int = 2048, pack: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition on vec_id; low, high: a negative's score lies between these shares of its positive's.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, is_anchor, scale)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    dim = -(-max(width, 1) // 64) * 64
    blocks = materialize(make_blocks(rows, dim, block), "coded")
    n, asks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asks"), F.lit(0))).first()
    packs = materialize(make_packs(rows, max(1, -(-asks // pack)), pack), "packs")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, round((tasks * asks / max(n, 1)) ** 0.5), -(-asks // CELL))
    cells = max(1, -(-tasks // columns)), columns

    found = search(on_grid(blocks, packs, *cells, same_label=True), positives, dim, 1, best_of_own_label(positives))
    near = materialize(ranked(found, positives), "positives")
    told = near.groupBy(F.col("pack").alias("of")).agg(F.collect_list(F.struct("search", "rank", "vec_id", "score")).alias("told"))  # at most ``positives`` for each of a pack's anchors

    def with_positives(batches):
        for b in batches:
            for r in b.to_pylist():
                score, there = np.zeros((r["q_n"], positives), "<i8"), np.zeros((r["q_n"], positives), bool)
                at, rank = ([t[c] for t in r["told"]] for c in ("search", "rank"))
                score[at, np.array(rank) - 1], there[at, np.array(rank) - 1] = [t["score"] for t in r["told"]], True
                yield pa.RecordBatch.from_arrays([pa.array([r["pack"]]), pa.array([r["q_label"]], pa.int32()), pa.array([r["q_n"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (r["q_ids"], r["q_rows"], score.tobytes(), there.tobytes()))], ["pack", "q_label", "q_n", "q_ids", "q_rows", "positive_scores", "positive_there"])

    ready = packs.join(told.hint("merge"), packs["pack"] == told["of"]).drop("of").mapInArrow(with_positives, f"{PACK}, positive_scores binary, positive_there binary")
    hard = ranked(search(on_grid(blocks, ready, *cells, same_label=False), negatives, dim, positives, best_in_range(negatives, positives, low, high)), negatives)

    def anchor_ids(batches):
        for b in batches:
            for pack_id, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(ids.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), pack_id)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["a_pack", "a_search", "anchor_id"])

    anchors = packs.select("pack", "q_ids").mapInArrow(anchor_ids, "a_pack long, a_search int, anchor_id long")
    pairs = near.join(anchors.hint("merge"), (near["pack"] == anchors["a_pack"]) & (near["search"] == anchors["a_search"]))
    pairs = pairs.select(F.col("pack").alias("p_pack"), (F.col("search") * positives + F.col("rank") - 1).alias("p_search"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pairs.hint("merge"), (hard["pack"] == pairs["p_pack"]) & (hard["search"] == pairs["p_search"]))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
