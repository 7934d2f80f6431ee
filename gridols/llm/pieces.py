"""N-best segmentation of whole texts into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for each vocabulary piece that matches, with the piece's score; a character that is
no piece has one edge, to the byte pieces of its UTF-8, at ``FALLBACK`` below the lowest score. Spaces are written as
the word mark, and one stands before the text. The forward pass gives each place its best score (Viterbi); these are
exact heuristics for an A-star search from the end backwards, which yields paths from the best down.

No piece reaches over the start of a word (checked when a vocabulary is read), so the lattice falls into cells, and
paths of a text are paths of its cells in turn. Forward and backward scores of all cells that a batch has not seen
before are found together, column by column. They also tell how much each cell's second-best path loses; the n best
paths of a text leave the best one in the n - 1 cells with the smallest such losses alone, so only these are
searched, and then a chain of their alternatives.

Nulls and the like: a null text counts as empty; an empty text has no pieces and no alternatives; a row without
a doc_id is encoded as any other; repeated rows get a row each; an empty table gives an empty result; columns other than
doc_id and text are not read, ``decode`` replaces columns named text and ids_crc32. Of equal scores the best path is the
one whose last piece is longest, from the end on; alternatives of equal loss are taken from the leftmost cells, and within
a cell in the order of the search, which the text alone decides. Time grows with a text's length, with or without spaces. A literal word mark in a text
goes to bytes, so decoding gives back every text exactly (a lone U+10FFFF aside, which is read as a word mark).
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridols.llm.langid import Index

MARK, LITERAL = "▁", "\U0010ffff"
FALLBACK = 10.0
CELL = r" +[^ \n]*|[^ \n]+|\n"
#: Cells over this length are walked edge by edge; the results are the same.
LONG = 128
#: Cells whose segmentation a worker keeps.
CACHE_CELLS = 150_000
#: Cells whose alternatives a worker keeps.
CACHE_SEARCHED = 20_000
PRIME = np.uint64(0x100000001B3)
EDITS = "array<struct<score:double,edits:array<struct<piece_from:int,piece_to:int,ids:array<int>>>>>"
ENCODED = f"doc_id long, ids array<int>, score double, alternatives {EDITS}, ids_crc32 long, decoded_crc32 long"

ENCODED_NAMES = ["doc_id", "ids", "score", "alternatives", "ids_crc32", "decoded_crc32"]


def a_star(n: int, into, forward, count: int):
    """The ``count`` best paths to node n as (score, labels), best first; into(j) lists (i, score, label) edges to j.

    Of equal estimates the newest is followed first, so that paths that tie are finished one by one.
    """
    heap, made = [(-forward[n], 0, 0.0, n, None)], 1
    while heap and count:
        _, _, done, j, tail = heapq.heappop(heap)
        if j == 0:
            path = []
            while tail:
                path.append(tail[0])
                tail = tail[1]
            count -= 1
            yield done, path
            continue
        for i, s, label in into(j):
            heapq.heappush(heap, (-(done + s + forward[i]), -made, done + s, i, (label, tail)))
            made += 1


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(n)]
        self.scores = np.array([m.get_score(i) for i in range(n)], np.float64)
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.id_of = {x: i for i, x in enumerate(self.names) if not special[i]}
        self.byte_id = {int(x[3:5], 16): i for i, x in enumerate(self.names) if m.is_byte(i)}
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in self.id_of):
            raise ValueError("a piece reaches over the start of a word")
        real = self.scores[[i for i in self.id_of.values() if self.scores[i] > -1e8]]
        self.fallback = float(real.min(initial=0.0)) - FALLBACK
        self.longest = max(map(len, self.id_of))
        prefixes = dict.fromkeys(x[:k] for x in self.id_of for k in range(1, len(x) + 1))
        self.index = Index(np.array([self.key(p) for p in prefixes], np.uint64))
        self.piece_at = np.array([self.id_of.get(p, -1) for p in prefixes], np.int64)
        self.raw = [bytes([int(x[3:5], 16)]) if m.is_byte(i) else b"" if special[i] else x.replace(MARK, " ").encode() for i, x in enumerate(self.names)]
        self.cell, self.known, self.searched = re.compile(CELL), {}, {}

    @staticmethod
    def key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(PRIME) + ord(c) + 1) % (1 << 64)
        return h

    def of_char(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in (MARK if c == LITERAL else c).encode()]

    def cells(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        return self.cell.findall(" " + text)

    def segment(self, cells) -> dict[str, tuple[bytes, float, float]]:
        """By cell: the best path's ids (int32 bytes), its score, and what the second-best path loses (inf: none)."""
        out, held, size = {}, [], 0
        for c in sorted(cells, key=len):
            if len(c) > LONG:
                out[c] = self.segment_long(c)
                continue
            held.append(c)
            size = len(held) * len(c)
            if size > 1 << 16:
                self.segment_chunk(held, out)
                held = []
        if held:
            self.segment_chunk(held, out)
        return out

    def segment_chunk(self, cells, out):
        w, n = len(cells), np.fromiter(map(len, cells), np.int64, len(cells))
        width = int(n.max())
        cp = np.array([c.replace(" ", MARK) for c in cells], f"<U{width}").view(np.uint32).reshape(w, width)
        best, tail = np.full((w, width + 1), -np.inf), np.full((w, width + 1), -np.inf)
        back, used = np.zeros((w, width + 1), np.int32), np.full((w, width + 1), -1, np.int32)
        best[:, 0], tail[np.arange(w), n] = 0.0, 0.0
        edges = []
        for i in range(width):
            rows = np.flatnonzero(n > i)
            h = np.zeros(len(rows), np.uint64)
            for j in range(i + 1, min(i + self.longest, width) + 1):
                inside = n[rows] >= j
                rows, h = rows[inside], h[inside]
                if not len(rows):
                    break
                h = h * PRIME + cp[rows, j - 1] + np.uint64(1)
                at = self.index.find(h)
                piece = np.where(at >= 0, self.piece_at[at], -1)
                if j == i + 1:
                    edges.append((rows, i, j, piece, np.where(piece >= 0, self.scores[piece], self.fallback)))
                elif (hit := piece >= 0).any():
                    edges.append((rows[hit], i, j, piece[hit], self.scores[piece[hit]]))
                else:
                    hit = None
                if j == i + 1 or hit is not None:
                    r, _, _, p, s = edges[-1]
                    total = best[r, i] + s
                    up = total > best[r, j]  # of equal scores the longer last piece stays: it came first
                    r, p = r[up], p[up]
                    best[r, j], back[r, j], used[r, j] = total[up], i, p
                rows, h = rows[at >= 0], h[at >= 0]
        for r, i, j, _, s in reversed(edges):
            tail[r, i] = np.maximum(tail[r, i], s + tail[r, j])
        on, rows, at, steps = np.zeros((w, width + 1), bool), np.arange(w), n.copy(), []
        while len(rows):
            on[rows, at] = True
            steps.append((rows, used[rows, at]))
            at = back[rows, at].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        loss, top = np.full(w, np.inf), best[np.arange(w), n]
        for r, i, j, _, s in edges:
            off = ~(on[r, j] & (back[r, j] == i))
            r, s = r[off], s[off]
            loss[r] = np.minimum(loss[r], top[r] - (best[r, i] + s + tail[r, j]))
        count = np.zeros(w, np.int64)
        for rows, _ in steps:
            count[rows] += 1
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]), np.int32)
        for k, (rows, ids) in enumerate(steps):
            flat[ends[rows] - 1 - k] = ids
        raw = flat.tobytes()
        holed = np.zeros(w, bool)
        holed[np.repeat(np.arange(w), count)[flat < 0]] = True
        for k, c in enumerate(cells):
            a, b = int(ends[k] - count[k]), int(ends[k])
            ids = raw[4 * a : 4 * b]
            if holed[k]:
                at, path = int(n[k]), []
                while at:
                    i = int(back[k, at])
                    path[:0] = [int(used[k, at])] if used[k, at] >= 0 else self.of_char(c[i])
                    at = i
                ids = np.array(path, np.int32).tobytes()
            out[c] = (ids, float(top[k]), float(loss[k]))

    def lattice(self, cell: str):
        """(from, to, piece, score) of the edges of one cell, by to and then from; piece is -1 where a character goes to bytes."""
        cp = np.frombuffer(cell.replace(" ", MARK).encode("utf-32-le"), "<u4")
        h, at, found = np.zeros(len(cp), np.uint64), np.arange(len(cp)), []
        for width in range(1, self.longest + 1):
            at = at[at + width <= len(cp)]
            if not len(at):
                break
            h[at] = h[at] * PRIME + cp[at + width - 1] + np.uint64(1)
            row = self.index.find(h[at])
            piece = np.where(row >= 0, self.piece_at[row], -1)
            hit = piece >= 0 if width > 1 else np.ones(len(at), bool)
            found.append((at[hit], at[hit] + width, piece[hit]))
            at = at[row >= 0]
        i, j, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((i, j))
        i, j, piece = i[order], j[order], piece[order]
        return i, j, piece, np.where(piece >= 0, self.scores[piece], self.fallback)

    def segment_long(self, cell: str) -> tuple[bytes, float, float]:
        """What ``segment`` gives, for one cell of any length: all places at a time, then one walk over the edges each way."""
        i, j, piece, score = self.lattice(cell)
        n = len(cell)
        best, tail, back, used = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0], [0] * (n + 1), [-1] * (n + 1)
        edges = list(zip(i.tolist(), j.tolist(), piece.tolist(), score.tolist(), strict=True))
        for a, b, p, s in edges:
            if best[a] + s > best[b]:
                best[b], back[b], used[b] = best[a] + s, a, p
        for a, b, _, s in reversed(edges):
            tail[a] = max(tail[a], s + tail[b])
        path, on, at = [], np.zeros(n + 1, bool), n
        while at:
            on[at] = True
            path.append([used[at]] if used[at] >= 0 else self.of_char(cell[back[at]].replace(" ", MARK)))
            at = back[at]
        off = ~(on[j] & (np.array(back)[j] == i))
        through = np.array(best)[i] + score + np.array(tail)[j]
        return np.array([x for ids in reversed(path) for x in ids], np.int32).tobytes(), best[n], float((best[n] - through[off]).min(initial=np.inf))

    def edges_of(self, cell: str):
        """(into, forward) of a cell's lattice for the search; labels are tuples of ids."""
        s = cell.replace(" ", MARK)
        if len(cell) > LONG:
            into, forward = [[] for _ in range(len(s) + 1)], [0.0] + [-np.inf] * len(s)
            for i, j, p, x in zip(*(c.tolist() for c in self.lattice(cell)), strict=True):
                into[j].append((i, x, (p,) if p >= 0 else tuple(self.of_char(s[i]))))
                forward[j] = max(forward[j], forward[i] + x)
            return into.__getitem__, forward
        into = [[] for _ in range(len(s) + 1)]
        forward = [0.0] + [-np.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - self.longest), j):
                p = self.id_of.get(s[i:j])
                if p is not None:
                    into[j].append((i, float(self.scores[p]), (p,)))
                elif i == j - 1:
                    into[j].append((i, self.fallback, tuple(self.of_char(s[i]))))
            forward[j] = max(forward[i] + x for i, x, _ in into[j])
        return into.__getitem__, forward

    def alternatives(self, cell: str, best: bytes, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """The next ``count`` paths of a cell after its best, as (loss, ids)."""
        if (cell, count) in self.searched:
            return self.searched[cell, count]
        into, forward = self.edges_of(cell)
        out = []
        for score, path in a_star(len(cell), into, forward, count + 1):
            ids = tuple(i for label in path for i in label)
            if np.array(ids, np.int32).tobytes() != best:
                out.append((forward[-1] - score, ids))
        if len(self.searched) < CACHE_SEARCHED and len(cell) < 100:
            self.searched[cell, count] = out[:count]
        return out[:count]

    def encode(self, batch: list[str | None], n_best: int):
        """For each whole text (ids, score, alternatives); an alternative is (score, edits to the best path's ids)."""
        split = [self.cells(t or "") for t in batch]
        fresh = set().union(*split).difference(self.known)
        new = self.segment(fresh)
        if len(self.known) + len(new) > CACHE_CELLS:
            found = {c: self.known[c] for c in set().union(*split).difference(fresh)} | new
            if len(self.known) < CACHE_CELLS:
                self.known |= dict(list(new.items())[: CACHE_CELLS - len(self.known)])
        else:
            self.known |= new
            found = self.known
        for cells in split:
            if not cells:
                yield np.zeros(0, np.int32), 0.0, []
                continue
            best, scores, loss = zip(*map(found.__getitem__, cells), strict=True)
            score = float(sum(scores))
            yield np.frombuffer(b"".join(best), np.int32), score, self.text_alternatives(cells, best, loss, score, n_best) if n_best > 1 else []

    def text_alternatives(self, cells, best, loss, score, n_best):
        loss = np.array(loss)
        last = np.partition(loss, n_best - 2)[n_best - 2] if len(loss) >= n_best else np.inf
        able = np.flatnonzero(loss <= last)
        near = able[np.argsort(loss[able], kind="stable")][: n_best - 1]  # the smallest losses; of equal ones the leftmost
        near = sorted(int(k) for k in near if np.isfinite(loss[k]))
        ways = [[(0.0, None), *self.alternatives(cells[k], best[k], n_best - 1)] for k in near]
        chain = a_star(len(near), lambda j: [(j - 1, -lost, (j - 1, ids)) for lost, ids in ways[j - 1]], [0.0] * (len(near) + 1), n_best)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, best), np.int64, len(best)) // 4)])
        out = []
        for gain, path in chain:
            edits = [{"piece_from": int(starts[near[j]]), "piece_to": int(starts[near[j] + 1]), "ids": list(ids)} for j, ids in path if ids is not None]
            if edits:
                out.append({"score": score + gain, "edits": edits})
        return out[: n_best - 1]

    def decode(self, ids) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")[1:]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(documents: DataFrame, vocabulary: str, n_best: int = 4) -> DataFrame:
    """(doc_id, ids, score, alternatives, ids_crc32, decoded_crc32): the best path of each whole text, and the next n_best - 1 as edits to it.

    The checksums are of the ids as unsigned 32-bit integers, and of the UTF-8 text that they decode to.
    """
    import zlib

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(StructType.fromDDL(f"a {EDITS}")["a"].dataType)

    def run(batches):
        p = pieces(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, score, more = zip(*p.encode(part.column(1).to_pylist(), n_best), strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(score, pa.float64()), pa.array(more, kind), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([zlib.crc32(p.decode(x.tolist()).encode()) for x in ids], pa.int64())], ENCODED_NAMES)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows with the columns text (decoded from ids) and ids_crc32 (of the ids as unsigned 32-bit integers) added."""
    import zlib

    at = encoded.columns.index("ids")
    others = [f for f in encoded.schema if f.name not in ("text", "ids_crc32")]
    schema = StructType([*others, StructField("text", StringType()), StructField("ids_crc32", LongType())])

    def run(batches):
        p = pieces(vocabulary)
        for batch in batches:
            lists = batch.column(at)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            each = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            kept = [(f.name, batch.column(k)) for k, f in enumerate(batch.schema) if f.name not in ("text", "ids_crc32")]
            text = pa.array([p.decode(x.tolist()) for x in each], pa.string())
            crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), text, crc], [*(c for c, _ in kept), "text", "ids_crc32"])

    return encoded.mapInArrow(run, schema)
