"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark, their document frequencies those of all documents outside of word triples that an
item has too, so that a passage under test does not make its own words common. Terms in more than ``max_df`` of the
documents are stop words of no weight, but for the terms of items that would lose half of their weight or more by that;
document passages are windows of ``window`` words at every ``stride`` words. A
randomised SVD of the TF-IDF matrix of passages and benchmark items gives a latent space, the index: a random test matrix
is pushed through the passages by Spark (partial products are summed by term), the singular vectors follow from this one
pass (Nystrom), and only matrices of terms by rank ever meet in one place. The axes are fitted on all passages of all
documents and on all items, whose rows count ``item_weight`` times so that few axes hold them; every passage of every
document is projected on them and searched. Items are cut into passages of
``window`` words too, so that a long item is met by passages of its own length. A document passage whose latent vector
has cosine ``min_cosine`` or more with an item's passage is a candidate for the item as a whole; so is, whatever the
weights, every place that has a word triple of an item (all its words if it has fewer; triples of over ``COMMON`` items
count only for items that have no other). Candidates are checked word by word on the stretch of text where the whole item
would lie: with ``whole`` or more of the item's words in a longest common subsequence the document holds a copy; from
``part`` on it holds a paraphrase if it also gives the item's answer (the rarest words of the item's last sentence).

The benchmark's terms and items are broadcast, by words and sparse counts, never as a matrix of items by terms;
``MOST_ITEMS`` items and ``MOST_BYTES`` of their text bound a pass, and a larger benchmark takes more passes.

Nulls and the like: null and empty texts hold no passage; items without a word match nothing; several texts under one
item_id are items of their own whose matches meet under that id; a text shorter than a window is one passage; rows without
a doc_id are left out of ``matches`` and kept by ``remove``; repeated rows match alike, and of a document's matches with an
item the one with the largest figures counts; words of equal rarity are taken in alphabetical order for an answer; columns
of other names are not read, and ``remove`` keeps them; empty tables give empty results. Texts are searched whole, long
ones in pieces of bounded size.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.llm.common import texts, without

MOST_ITEMS = 20_000
MOST_BYTES = 32 << 20
#: Words of documents that are laid out together, and words whose vectors are held at once.
TOGETHER = 1 << 15
COMMON = 100
#: A-Z to a-z; all ASCII but letters and digits to spaces.
PLAIN = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and whatever is beyond ASCII, with A-Z lowered."""
    return (text or b"").translate(PLAIN).split()


def gram_keys(t: np.ndarray, n: int) -> np.ndarray:
    """One number for each run of n terms; equal runs have equal ones, and what differs is told apart by the checks."""
    out = np.zeros(max(0, len(t) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ t[i : i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Items:
    """The items of one pass: words, term numbers, passages, idf, latent vectors and answers."""

    def __init__(self, rows: list[tuple[int, bytes]], window: int = 48):
        self.ids = [i for i, _ in rows]
        split = [words(t) for _, t in rows]
        self.names = sorted(set(chain.from_iterable(split)))
        self.terms = {w: k for k, w in enumerate(self.names)}
        self.seqs = [np.array([self.terms[w] for w in ws], np.int64) for ws in split]
        self.last = [words(s[-1]) if (s := [x for x in re.split(rb"[.!?\n]", t or b"") if words(x)]) else [] for _, t in rows]
        cuts = [(k, at) for k, s in enumerate(self.seqs) if len(s) for at in passage_starts(len(s), window)]
        self.item, self.offset = (np.array([c[j] for c in cuts], np.int64) for j in (0, 1))
        self.passages = [self.seqs[k][at : at + window] for k, at in cuts]
        self.masks: dict[int, dict[int, int]] = {}

        self.grams = {n: g for n in (1, 2, 3) if len((g := self.gram_table(n))[0])}

    @property
    def words(self) -> list[list[bytes]]:
        return [[self.names[k] for k in s] for s in self.seqs]

    def gram_table(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys ascending, first row of each key, item, offset): where the items' runs of n terms are; shorter runs are whole items."""
        rows = [(k, gram_keys(s, n)) for k, s in enumerate(self.seqs) if min(len(s), 3) == n]
        key = np.concatenate([g for _, g in rows]) if rows else np.zeros(0, np.uint64)
        item = np.repeat([k for k, _ in rows], [len(g) for _, g in rows]).astype(np.int64)
        offset = np.concatenate([np.arange(len(g)) for _, g in rows]) if rows else np.zeros(0, np.int64)
        _, number, times = np.unique(key, return_inverse=True, return_counts=True)
        rare = times[number] <= COMMON
        has = np.zeros(len(self.ids), bool)
        has[item[rare]] = True
        kept = np.flatnonzero(rare | ~has[item])
        kept = kept[np.argsort(key[kept], kind="stable")]
        keys, first = np.unique(key[kept], return_index=True)
        return keys, np.append(first, len(kept)), item[kept], offset[kept]

    def gram_hits(self, t: np.ndarray):
        """(n, places, rows of the keys) of the runs of n terms that are in the table."""
        for n, (keys, *_) in self.grams.items():
            known = t >= 0
            at = np.flatnonzero(np.logical_and.reduce([known[i : len(t) - n + 1 + i] for i in range(n)])) if len(t) >= n else np.zeros(0, np.int64)
            if len(at):
                found = gram_keys(t, n)[at]
                row = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = keys[row] == found
                yield n, at[hit], row[hit]

    def covered(self, t: np.ndarray) -> np.ndarray:
        """Whether each word of a text is in a run that an item has too."""
        out = np.zeros(len(t), bool)
        for n, at, _ in self.gram_hits(t):
            for i in range(n):
                out[at + i] = True
        return out

    def places(self, t: np.ndarray, doc: np.ndarray | None = None):
        """(document, item, start): where a text has a run of an item, by the item's start; starts of one item are over half its length apart.

        doc tells each word's document, if t holds several, with a gap between them.
        """
        for n, at, row in self.gram_hits(t):
            _, first, item, offset = self.grams[n]
            count = first[row + 1] - first[row]
            k = np.repeat(first[row] - np.cumsum(count) + count, count) + np.arange(count.sum())
            start, which = np.repeat(at, count) - offset[k], item[k]
            own = np.zeros(len(start), np.int64) if doc is None else doc[np.repeat(at, count)]
            order = np.lexsort((start, which, own))
            start, which, own = start[order], which[order], own[order]
            fresh = np.append(True, (np.diff(own) != 0) | (np.diff(which) != 0) | (np.diff(start) != 0)) if len(start) else np.zeros(0, bool)
            before, end = None, 0
            for d, x, p in zip(own[fresh].tolist(), which[fresh].tolist(), start[fresh].tolist(), strict=True):
                if (d, x) != before or p > end:
                    before, end = (d, x), p + len(self.seqs[x]) // 2
                    yield d, x, p

    def weights(self, df: np.ndarray, total: int, max_df: float) -> np.ndarray:
        """Inverse document frequencies; 0 for stop words that no item needs."""
        full = np.maximum(np.log((2 + total) / (1 + df)), 0.1)
        idf = np.where(df > max(max_df * total, 5), 0.0, full)
        needed = np.zeros(len(idf), bool)
        for s in self.seqs:
            if 2 * idf[s].sum() <= full[s].sum():
                needed[s] = True
        return np.where(needed, full, idf)

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The passages' term counts by a matrix of terms by columns; passages by columns, without a dense row of terms."""
        return np.array([basis[s].sum(axis=0) for s in self.passages]).reshape(len(self.passages), basis.shape[1])

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The transposed term counts by a matrix of passages by columns; terms by columns."""
        out = np.zeros((len(self.terms), rows.shape[1]))
        for r, s in zip(rows, self.passages, strict=True):
            np.add.at(out, s, r)
        return out

    def finish(self, idf: np.ndarray, axes: np.ndarray, answer_words: int) -> None:
        """axes: terms by rank."""
        self.vectors, self.told = (idf[:, None] * axes).astype(np.float32), np.append(idf > 0, False)
        self.own = [np.unique(s) for s in self.seqs]
        self.latent = unit(self.times(self.vectors))
        self.entire = unit(np.array([self.vectors[s].sum(axis=0) for s in self.seqs]).reshape(len(self.seqs), axes.shape[1]))
        rare = lambda ws: sorted(set(ws), key=lambda w: (-idf[self.terms[w]], w))[:answer_words]
        self.answers = [{self.terms[w] for w in rare(ws)} for ws in self.last]

    def cosine(self, k: int, t: np.ndarray) -> float:
        """That of an item and the words t; 0 if they have no weight."""
        return float(unit(self.vectors[t[self.told[t]]].sum(axis=0)[None])[0] @ self.entire[k])

    def share(self, k: int, around: np.ndarray, part: float) -> float:
        """The share of an item's words in a longest common subsequence with the words around; 0 if it must be below part."""
        own, n = self.own[k], len(self.seqs[k])
        around = around[own[np.minimum(np.searchsorted(own, around), len(own) - 1)] == around]
        if len(around) < part * n:
            return 0.0
        if k not in self.masks:
            self.masks[k] = places_by_word(self.seqs[k])
        return common_length(self.masks[k], n, around) / n


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1; rows of no weight stay zero."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norm > 1e-6, rows / np.where(norm > 1e-6, norm, 1), 0).astype(np.float32)


def passage_starts(n: int, window: int) -> list[int]:
    """Starts of as few full windows as cover n words, evenly spread; one at 0 if n is at most a window."""
    many = -(-n // window)
    return [0] if many <= 1 else [round(k * (n - window) / (many - 1)) for k in range(many)]


def term_numbers(text: bytes | None, terms: dict[bytes, int], piece: int = 1 << 20) -> np.ndarray:
    """The term of each word of a text, -1 for words of no item; long texts are split in pieces."""
    plain, out, at = (text or b"").translate(PLAIN), [], 0
    while at < len(plain) or not out:
        end = at + piece
        while end < len(plain) and not plain[end : end + 1].isspace():
            end += 1
        ws = plain[at:end].split()
        out.append(np.fromiter(map(terms.get, ws, repeat(-1)), np.int64, len(ws)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


class Layout:
    """Documents' terms one after another, a gap behind each, and the grid of their passages.

    A document's words fall into blocks of ``stride`` words; a passage is the ``reach`` blocks from one on, and there are
    as many passages as it takes to come to the document's end.
    """

    def __init__(self, terms: list[np.ndarray], window: int, stride: int):
        self.reach = window // stride
        size = np.array([len(x) for x in terms], np.int64)
        self.base = np.cumsum(size + 1) - size - 1
        gap = np.full(1, -1, np.int64)
        self.t = np.concatenate([x for y in terms for x in (y, gap)]) if terms else gap[:0]
        self.size, self.doc = size, np.repeat(np.arange(len(size)), size + 1)
        blocks = -(-size // stride)
        room = blocks + self.reach - 1
        self.first = np.cumsum(room) - room  # each document's first block; behind its blocks are reach - 1 empty ones
        self.total = int(room.sum())
        place = np.arange(len(self.t)) - self.base[self.doc]
        self.block = self.first[self.doc] + place // stride
        count = np.where(size > 0, np.maximum(1, blocks - self.reach + 1), 0)
        self.own = np.repeat(np.arange(len(size)), count)  # each passage's document
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.start, self.at = nth * stride, self.first[self.own] + nth

    def block_sums(self, told: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The vectors of the told words summed by block."""
        out = np.zeros((self.total + self.reach, vectors.shape[1]), vectors.dtype)
        words = np.flatnonzero(told[self.t])
        block = self.block[words]
        head = np.flatnonzero(np.diff(block, prepend=-1))
        cut = 0
        while cut < len(head):
            stop = max(cut + 1, int(np.searchsorted(head, head[cut] + TOGETHER)))
            lo, hi = head[cut], head[stop] if stop < len(head) else len(words)
            out[block[head[cut:stop]]] = np.add.reduceat(vectors[self.t[words[lo:hi]]], head[cut:stop] - lo, axis=0)
            cut = stop
        return out

    def passage_sums(self, sums: np.ndarray, some: slice) -> np.ndarray:
        at = self.at[some]
        out = sums[at].copy()
        for k in range(1, self.reach):
            out += sums[at + k]
        return out


def layouts(batch, terms: dict[bytes, int], window: int, stride: int):
    """(first row, layout) of a batch's texts, a group of texts of about TOGETHER words at a time."""
    held, size, first = [], 0, 0
    for k, text in enumerate(batch):
        held.append(term_numbers(text.as_py(), terms))
        size += len(held[-1])
        if size >= TOGETHER or k == len(batch) - 1:
            yield first, Layout(held, window, stride)
            held, size, first = [], 0, k + 1


def places_by_word(a: np.ndarray) -> dict[int, int]:
    """By word the bits of its places."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_length(masks: dict[int, int], n: int, b: np.ndarray) -> int:
    """Length of the longest common subsequence of b and the n words of the masks, by bit-parallel rows."""
    v = full = (1 << n) - 1
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    return common_length(places_by_word(a), len(a), b)


def frequencies(docs: DataFrame, held) -> tuple[np.ndarray, int]:
    """Documents that hold each term outside of the items' own runs, and documents in all."""

    def run(batches):
        terms = held.value.terms
        df, total = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, lay in layouts(batch.column(1), terms, 16, 16):
                alone = np.flatnonzero((lay.t >= 0) & ~held.value.covered(lay.t))
                once = np.unique(lay.doc[alone] * len(terms) + lay.t[alone])
                df += np.bincount(once % max(1, len(terms)), minlength=len(terms))
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], total))], ["term", "n"])

    df, total = np.zeros(len(held.value.terms)), 0
    for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, total


def pushed(docs: DataFrame, held, idf: np.ndarray, basis: np.ndarray, window: int, stride: int) -> np.ndarray:
    """A'(A basis), A being the TF-IDF matrix of all document passages; terms by columns of the basis."""
    given = docs.sparkSession.sparkContext.broadcast(idf[:, None] * basis)
    width = basis.shape[1]

    def run(batches):
        terms, b, told = held.value.terms, given.value, np.append(idf > 0, False)
        out = np.zeros((len(terms), width))
        for batch in batches:
            for _, lay in layouts(batch.column(1), terms, window, stride):
                sums = lay.block_sums(told, b)
                back = np.zeros_like(sums)  # by block the sum over the passages that hold it of their rows of A basis
                for at in range(0, len(lay.at), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    y = lay.passage_sums(sums, some)
                    for k in range(lay.reach):
                        back[lay.at[some] + k] += y
                words = np.flatnonzero(told[lay.t])
                for at in range(0, len(words), TOGETHER):
                    few = words[at : at + TOGETHER]
                    few = few[np.argsort(lay.t[few], kind="stable")]
                    cut = np.flatnonzero(np.diff(lay.t[few], prepend=-1))
                    out[lay.t[few[cut]]] += np.add.reduceat(back[lay.block[few]], cut, axis=0)
        used = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used].tolist(), pa.list_(pa.float64()))], ["term", "v"])

    sums = docs.mapInArrow(run, "term long, v array<double>").groupBy("term").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)))
    out = np.zeros((len(idf), width))
    for r in sums.collect():  # a row for each term
        out[r["term"]] = r[1:]
    return out * idf[:, None]


def latent_axes(docs: DataFrame, held, idf: np.ndarray, rank: int, window: int, stride: int, item_weight: float = 1.0, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (terms by rank) of the passages and items, by a single-pass (Nystrom) sketch."""
    own = held.value
    width = min(rank + 8, len(idf))
    test = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), width)))[0]
    y = pushed(docs, held, idf, test, window, stride) + item_weight**2 * idf[:, None] * own.back(own.times(idf[:, None] * test))
    shift = 1e-9 * np.linalg.norm(y) + 1e-300
    y += shift * test
    core = test.T @ y
    low = np.linalg.cholesky((core + core.T) / 2)
    return np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)[0][:, :rank]


def matches(documents: DataFrame, benchmark: DataFrame, rank: int = 96, item_weight: float = 30.0, window: int = 48, stride: int = 16, min_cosine: float = 0.6, max_df: float = 0.05, whole: float = 0.8, part: float = 0.55, answer_words: int = 3) -> DataFrame:
    """(doc_id, item_id, cosine, common): every document that holds an item, with the best passage's figures."""
    spark = documents.sparkSession
    docs = texts(documents).select("doc_id", F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id IS NOT NULL").distinct()
    count = items.count()
    rows = ((r[0], bytes(r[1] or b"")) for r in (items.orderBy("item_id", "text").toLocalIterator() if count else ()))
    found = None
    for batch in passes(rows):
        one = pass_over(spark, docs, Items(batch, window), rank, item_weight, window, stride, min_cosine, max_df, whole, part, answer_words)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, common double")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"))


def passes(rows):
    """Lists of at most MOST_ITEMS items with MOST_BYTES of text, or one item."""
    held, size = [], 0
    for r in rows:
        if held and (len(held) >= MOST_ITEMS or size + len(r[1]) > MOST_BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r[1])
    if held:
        yield held


def pass_over(spark: SparkSession, docs, items: Items, rank, item_weight, window, stride, min_cosine, max_df, whole, part, answer_words) -> DataFrame:
    held = spark.sparkContext.broadcast(items)
    df, total = frequencies(docs, held)
    idf = items.weights(df, total, max_df)
    items.finish(idf, latent_axes(docs, held, idf, min(rank, len(idf)), window, stride, item_weight) if len(idf) else np.zeros((0, 0)), answer_words)
    ready = spark.sparkContext.broadcast(items)

    def run(batches):
        it = ready.value
        for batch in batches:
            docs_, out = batch.column(0).to_pylist(), []
            for first, lay in layouts(batch.column(1), it.terms, window, stride):
                out += [(docs_[first + d], it.ids[k], c, share) for d, k, c, share in search(lay, it, window, min_cosine, whole, part)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "common"])

    return docs.mapInArrow(run, "doc_id long, item_id long, cosine double, common double")


def search(lay: Layout, it: Items, window: int, min_cosine: float, whole: float, part: float, cells: int = 1 << 22):
    """(document's place, item's place, cosine, share of the item's words in common) of each item that a document holds."""
    best: dict[tuple[int, int], tuple[float, float]] = {}

    def check(d: int, k: int, cosine, lo: int, hi: int) -> None:
        """Whether document d holds item k between its words lo and hi."""
        a = lay.base[d]
        around = lay.t[a + max(0, lo) : a + min(int(lay.size[d]), hi)]
        around = around[around >= 0]
        share = it.share(k, around, part)
        if share >= whole or share >= part and it.answers[k] <= set(around.tolist()):
            best[d, k] = max(best.get((d, k), (0.0, 0.0)), (cosine(), share), key=lambda x: x[::-1])

    sums = lay.block_sums(it.told, it.vectors)
    piece = max(1, cells // max(1, len(it.latent)))  # document passages by item passages
    found = []
    for at in range(0, len(lay.at), piece):
        v = lay.passage_sums(sums, slice(at, at + piece))
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        some = np.flatnonzero(norm > 1e-6)
        dots, least = v[some] @ it.latent.T, np.float32(min_cosine) * norm[some]
        i, j = np.nonzero(dots >= least[:, None])
        found.append((at + some[i], j, dots[i, j] / norm[some[i]]))
    if found:
        p, j, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        d, k, lo = lay.own[p], it.item[j], lay.start[p] - it.offset[j]
        before, seen = None, (0, 0)
        for x in np.lexsort((lo, k, d)).tolist():
            one, size = (int(d[x]), int(k[x])), len(it.seqs[k[x]])
            # the item's stretch of text, if this passage of it lies anywhere in that window
            start, end = int(lo[x]), int(lo[x]) + max(size, window)
            slack = size if size <= window else max(window, size // 4)
            if one == before and start >= seen[0] and end <= seen[1] or best.get(one, (0, 0))[1] == 1:
                continue
            before, seen = one, (start - slack, end + slack)
            check(*one, lambda: float(cosine[x]), *seen)
    for d, k, at in it.places(lay.t, lay.doc):
        if best.get((d, k), (0, 0))[1] < 1:
            size, start = len(it.seqs[k]), at - int(lay.base[d])
            slack = size if size <= window else max(window, size // 4)
            own = lay.t[max(int(lay.base[d]), at) : min(at + size, int(lay.base[d] + lay.size[d]))]
            check(d, k, lambda: it.cosine(k, own), start - slack, start + size + slack)
    return [(d, k, c, share) for (d, k), (c, share) in best.items()]


def remove(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark item."""
    return without(documents, matches(documents, benchmark, **how))
