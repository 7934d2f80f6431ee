"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are put in the order of ``pivots`` sampled vectors that they are closest to, and consecutive ones form
document-range blocks; this order only makes blocks tight, any order gives the same results. Each block keeps the extreme
value of every term (vector position); from these a query gets an upper bound of its score on the block, the sum of its
term maxima. ``GROUP`` consecutive blocks make a group. Within a group a query visits the blocks from the highest bound down,
scoring each through its forward index (its rows) until no bound reaches its kth score.

There are two rounds. In the first a query visits the group that it is in itself, its neighbourhood, which gives it a kth
score to begin with. In the second packs of queries meet the groups on a grid: a group goes to ``columns`` cells and a pack
to ``rows`` cells, chosen so that both sides move about the same number of bytes, and no row moves once for each pair. A cell
keeps the lists of its queries, so each group that is visited raises the score that the next one has to reach.
``pruning`` reports how many pairs of query and block were skipped.

Nulls and the like: vectors that are null, or hold a null, NaN or infinite component take no part, and neither do rows
without an id; an empty vector scores 0 with every other. Scores are exact up to 2**63; larger ones, and components from
2**53 on after scaling, raise an error. Vectors of different lengths meet as if the shorter ended in zeros. Repeated ids are
separate candidates, except that a query never meets a row of its own id; query rows that share an id are one query, whose
list holds the k best of all their pairs. Ties go to the smaller id. Columns other than vec_id and embedding are not read.
Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridols.llm.common import materialize

FOUND = "query_id long, vec_id long, score long"
BLOCKS = "grp long, n int, blocks int, ids binary, rows binary, starts binary, high binary, low binary, asks binary"
PACK = "pack long, q_n int, q_ids binary, q_rows binary, q_least binary"
#: Blocks of a group, and queries whose lists a cell keeps.
GROUP, CELL = 64, 1 << 16
#: What stands for no candidate in a list of scores.
NONE = np.iinfo(np.int64).min


def quantize(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): every component x as floor(scale * x), x as double; rows that take no part are gone."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", ok))
        .select("vec_id", F.transform("v", lambda x: whole(x * F.lit(scale))).alias("v"))
    )


def whole(x):
    """The whole number at or below x; one of 2**53 or more in size is refused."""
    large = F.raise_error(F.lit("a component is 2**53 or more after scaling"))
    return F.when(F.abs(x) >= F.lit(float(2**53)), large).otherwise(F.floor(x)).cast("long")


def to_bytes(m: np.ndarray) -> bytes:
    """A matrix of whole numbers in the narrowest type that holds it, behind its type and width."""
    top = max(-int(m.min(initial=0)), int(m.max(initial=0)))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind.encode() + m.shape[1].to_bytes(5, "little") + np.ascontiguousarray(m, kind).tobytes()


def to_matrix(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, b[:3].decode(), offset=8).reshape(n, int.from_bytes(b[3:8], "little")).astype(np.int64)


def dense(lists: pa.Array) -> np.ndarray:
    lens = np.diff(lists.offsets.to_numpy())
    rows = np.zeros((len(lists), int(lens.max(initial=0))), np.int64)
    rows[np.arange(rows.shape[1]) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


def padded(*ms: np.ndarray):
    """The matrices at equal width, as doubles if every inner product is exact in them; products of 2**63 or more are refused."""
    dim = max(m.shape[1] for m in ms)
    tops = [max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in ms]
    most = tops[0] * max(tops[1:], default=1) * dim
    if most >= 2**63:
        raise ValueError("scores may be 2**63 or more")
    kind = np.float64 if most < 2**53 else np.int64
    return [np.pad(m, ((0, 0), (0, dim - m.shape[1]))).astype(kind) for m in ms]


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the queries' scores on blocks: by term the larger of its products with the block's extremes, summed."""
    q, high, low = padded(q, high, low)
    return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)


def near_order(v: DataFrame, pivots: int) -> DataFrame:
    """(vec_id, v, asks, c, near): the pivot whose direction a vector is closest to, and how close; at most ``pivots`` vectors are collected."""
    held = v.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    some = [np.array(r["v"], float) for r in held]
    dim = max(map(len, some), default=0)
    m = np.array([np.pad(x, (0, dim - len(x))) for x in some]).reshape(len(some), dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    given = v.sparkSession.sparkContext.broadcast((m / np.where(norm > 0, norm, 1)).T)

    def run(batches):
        for b in batches:
            rows, p = dense(b.column(1)).astype(float), given.value
            width = max(rows.shape[1], len(p))
            dots = np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) @ np.pad(p, ((0, width - len(p)), (0, 0)))
            c = dots.argmax(axis=1) if dots.shape[1] else np.zeros(len(rows), np.int64)
            near = dots[np.arange(len(rows)), c] if dots.shape[1] else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.astype(np.int32)), pa.array(-near)], [*b.schema.names, "c", "near"])

    return v.mapInArrow(run, "vec_id long, v array<long>, asks boolean, c int, near double")


def make_groups(ordered: DataFrame, block: int) -> DataFrame:
    """Groups of at most ``GROUP`` blocks of ``block`` consecutive rows of each partition."""

    def run(batches):
        from pyspark import TaskContext

        made, held, size = TaskContext.get().partitionId() << 33, [], 0

        def pack(rows: pa.Table):
            nonlocal made
            ids, m = rows.column("vec_id").to_numpy(), dense(rows.column("v").combine_chunks())
            asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            starts = np.append(np.arange(0, len(ids), block), len(ids))
            high, low = np.maximum.reduceat(m, starts[:-1]), np.minimum.reduceat(m, starts[:-1])
            cols = [made, len(ids), len(starts) - 1, ids.astype("<i8").tobytes(), to_bytes(m), starts.astype("<i8").tobytes(), to_bytes(high), to_bytes(low), asks.tobytes()]
            made += 1
            types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], ["grp", "n", "blocks", "ids", "rows", "starts", "high", "low", "asks"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= GROUP * block:
                table = pa.Table.from_batches(held)
                for at in range(0, len(table) - GROUP * block + 1, GROUP * block):
                    yield pack(table.slice(at, GROUP * block))
                whole_groups = len(table) - len(table) % (GROUP * block)
                held = [x for x in table.slice(whole_groups).to_batches() if x.num_rows]
                size = len(table) - whole_groups
        if size:
            yield pack(pa.Table.from_batches(held))

    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(n, "c", "near", "vec_id").sortWithinPartitions("c", "near", "vec_id").select("vec_id", "v", "asks").mapInArrow(run, BLOCKS)


def merge(query, ids, score, who, cand, value, k):
    """Add candidates (who, cand, value) to the kept (ids, score) lists; ties go to the smaller id."""
    touched, none = np.unique(who), -np.inf if score.dtype.kind == "f" else NONE
    kept = np.flatnonzero(score[touched].ravel() > none)
    w = np.concatenate([who, np.repeat(touched, k)[kept]])
    c = np.concatenate([cand, ids[touched].ravel()[kept]])
    s = np.concatenate([value, score[touched].ravel()[kept]])
    order = np.lexsort((c, -s, w))
    w, c, s = w[order], c[order], s[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
    rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    w, c, s, rank = w[rank < k], c[rank < k], s[rank < k], rank[rank < k]
    ids[w, rank], score[w, rank] = c, s


def visit(qids, q, cids, rows, starts, high, low, k: int, least=None, held=None, tally=None):
    """The k best of some blocks for every query, from the highest bound down: (ids, scores) padded with -1 and NONE, exact.

    starts: the first row of each block and the number of rows; least: scores below these do not matter; held: lists that are
    known already and go on from here; tally: gets the number of pairs of query and block that were scored.
    """
    bound = bounds(q, high, low)
    q, rows = padded(q, rows)
    order = np.argsort(-bound, axis=1, kind="stable")
    ids, score = held if held is not None else (np.full((len(q), k), -1, np.int64), np.full((len(q), k), NONE))
    floor = np.full(len(q), NONE) if least is None else least
    for turn in range(len(starts) - 1):
        at = order[:, turn]
        live = np.flatnonzero(bound[np.arange(len(q)), at] >= np.maximum(score[:, -1], floor))
        if not len(live):
            break
        if tally is not None:
            tally.append(len(live))
        for b in np.unique(at[live]):
            who = live[at[live] == b]
            span = slice(starts[b], starts[b + 1])
            s = (q[who] @ rows[span].T).astype(np.int64)
            i, j = np.nonzero((s >= np.maximum(score[who, -1], floor[who])[:, None]) & (qids[who][:, None] != cids[span][None, :]))
            if len(i):
                merge(q, ids, score, who[i], cids[span][j], s[i, j], k)
    return ids, score


def opened(r: dict):
    """(ids, rows, starts, high, low) of a group."""
    return np.frombuffer(r["ids"], "<i8"), to_matrix(r["rows"], r["n"]), np.frombuffer(r["starts"], "<i8"), to_matrix(r["high"], r["blocks"]), to_matrix(r["low"], r["blocks"])


def stack(ms: list[np.ndarray]) -> np.ndarray:
    dim = max((m.shape[1] for m in ms), default=0)
    return np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in ms]) if ms else np.zeros((0, 0), np.int64)


def first_visit(groups: DataFrame, k: int, query_rows: int) -> DataFrame:
    """Packs of at most ``query_rows`` queries, each with the kth score of its own group (NONE with fewer rows)."""

    def run(batches):
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 33, []

        def send():
            nonlocal made, held
            ids, q, least = (np.concatenate(c) if j != 1 else stack(list(c)) for j, c in enumerate(zip(*held, strict=True)))
            for at in range(0, len(ids), query_rows):
                made += 1
                part = slice(at, at + query_rows)
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([len(ids[part])], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids[part].tobytes(), to_bytes(q[part]), least[part].tobytes()))], ["pack", "q_n", "q_ids", "q_rows", "q_least"])
            held = []

        for b in batches:
            for r in b.to_pylist():
                asks = np.frombuffer(r["asks"], bool)
                if not asks.any():
                    continue
                ids, rows, *blocks = opened(r)
                _, score = visit(ids[asks], rows[asks], ids, rows, *blocks, k)
                held.append((ids[asks], rows[asks], score[:, -1]))
                if sum(len(h[0]) for h in held) >= query_rows:
                    yield from send()
        if held:
            yield from send()

    return groups.mapInArrow(run, PACK)


def on_grid(groups: DataFrame, packs: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every pair of a group and a pack, in the cell of the grid where they meet."""
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    g = groups.drop("asks").select("*", F.pmod(F.xxhash64("grp"), F.lit(rows)).cast("int").alias("r"), spread("c", columns))
    p = packs.select("*", F.pmod(F.xxhash64("pack"), F.lit(columns)).cast("int").alias("q_c"), spread("q_r", rows))
    return g.join(p.hint("merge"), (g["r"] == p["q_r"]) & (g["c"] == p["q_c"])).drop("r", "c", "q_r", "q_c")  # never broadcast: copies for the grid are not in Spark's estimate


def plan(vectors: DataFrame, is_query, k: int, scale: float, block: int, pivots: int, query_rows: int):
    """(groups, packs, their pairs on the grid); the first two as tables in the shared folder."""
    v = quantize(vectors, scale).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    groups = materialize(make_groups(near_order(v, pivots), block), "groups")
    packs = materialize(first_visit(groups, k, query_rows), "packs")
    n, many = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], packs.agg(F.coalesce(F.sum("q_n"), F.lit(0))).first()[0]
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, round((tasks * many / max(n, 1)) ** 0.5), -(-many // CELL))
    return groups, packs, on_grid(groups, packs, max(1, -(-tasks // columns)), columns)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, block: int = 256, pivots: int = 256, query_rows: int = 2048) -> DataFrame:
    """Per query row the k best other rows by integer inner product: (query_id, rank, vec_id, score). is_query: a condition on vec_id."""
    _, _, pairs = plan(vectors, is_query, k, scale, block, pivots, query_rows)

    def run(batches):
        lists: dict[int, tuple] = {}

        def send():
            for ids, cand, score in lists.values():
                i, j = np.nonzero(score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(cand[i, j]), pa.array(score[i, j])], ["query_id", "vec_id", "score"])
            lists.clear()

        for b in batches:
            for r in b.to_pylist():
                ids, q, least = np.frombuffer(r["q_ids"], "<i8"), to_matrix(r["q_rows"], r["q_n"]), np.frombuffer(r["q_least"], "<i8")
                if r["pack"] not in lists:
                    if sum(len(x[0]) for x in lists.values()) > CELL:
                        yield from send()
                    lists[r["pack"]] = ids, np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), NONE)
                visit(ids, q, *opened(r), k, least, lists[r["pack"]][1:])
        yield from send()

    found = pairs.mapInArrow(run, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, block: int = 256, pivots: int = 256, query_rows: int = 2048) -> DataFrame:
    """(queries, blocks, pairs, visited, skipped_share): how many pairs of query and block the second round scores."""
    groups, packs, pairs = plan(vectors, is_query, k, scale, block, pivots, query_rows)

    def run(batches):
        lists: dict[int, tuple] = {}
        for b in batches:
            tally: list[int] = []
            for r in b.to_pylist():
                ids, q, least = np.frombuffer(r["q_ids"], "<i8"), to_matrix(r["q_rows"], r["q_n"]), np.frombuffer(r["q_least"], "<i8")
                lists.setdefault(r["pack"], (np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), NONE)))
                visit(ids, q, *opened(r), k, least, lists[r["pack"]], tally)
            yield pa.RecordBatch.from_arrays([pa.array([sum(tally)], pa.int64())], ["scored"])

    visited = pairs.mapInArrow(run, "scored long").agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]
    blocks, queries = groups.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0], packs.agg(F.coalesce(F.sum("q_n"), F.lit(0))).first()[0]
    share = 1 - visited / (blocks * queries) if blocks * queries else None
    return vectors.sparkSession.createDataFrame([(queries, blocks, queries * blocks, visited, share)], "queries long, blocks long, pairs long, visited long, skipped_share double")
