"""Exact removal of repeated 50-byte strings across documents, by sorting suffixes deep-shallow.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with a smaller doc_id. Sorting every suffix
of the corpus would shuffle fifty times its size, so suffixes meet only where they can match:

1. Winnowing gives each ``LENGTH``-byte window an anchor: the leftmost of its ``GRAM``-byte grams with the least hash.
   Equal windows have equal anchors. Anchors (four bytes of hash each, packed) are shuffled to find those that more
   than one document has. What is shared within a batch is settled there, so a very common gram is sent once a batch.
2. For these, segments (the windows of one anchor occurrence) are shuffled by anchor. Equal segments are merged before
   and after the shuffle: all but those of the smallest doc_id are removed whole. A crowded anchor, such as a phrase on
   every page, would bring many different segments to one task; its segments are cut into windows, which are shuffled by
   their own hash. An anchor is crowded if it has over ``CROWD`` occurrences and an eighth of its task's, so there are at
   most eight a task, and all of them are known to every task.
3. Where an anchor has several different segments left, their windows are sorted as suffixes: three-way multikey quicksort
   on eight-byte characters down to ``SHALLOW`` of them, then blind tries, whose nodes skip to the first character in which
   their members differ. Windows that stay equal over all ``LENGTH`` bytes form a class, and are removed but for the
   class's smallest doc_id.
4. Removed windows are gathered by document and cut out of its text.

Windows are told apart by their bytes, never by hashes alone; a colliding hash only costs a comparison. A task holds what
one of ``spark.sql.shuffle.partitions`` partitions brings it, about four times its share of the texts: size that setting
to the input, as for any shuffle.

Nulls and the like: a null text counts as empty; texts shorter than ``LENGTH`` keep all; rows without a doc_id are left
out; rows of one doc_id get a row each and do not remove from each other, whether their texts are equal or not, while each
of them removes from larger doc_ids; a window that several documents share stays with the smallest doc_id, wherever it
stands there; columns of other names are not read; an empty table gives an empty result. Long texts are worked on in
pieces that overlap, and are treated whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize, texts

LENGTH, GRAM = 50, 20
SHALLOW = 2
PIECE = 1 << 19
#: Anchors, and segments, that a task holds before it sends them on.
HELD = 1 << 20
HELD_SEGMENTS = 1 << 18
#: Occurrences from which on an anchor can be crowded.
CROWD = 4096
MULTIPLIER = 0x9E3779B97F4A7C15
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
ROWS = "bucket int, kind int, blob binary"


def row(bucket: int, kind: int, *arrays: np.ndarray) -> tuple[int, int, bytes]:
    """Arrays in one compressed blob, each behind its dtype and length."""
    import zstandard

    raw = b"".join(str(a.dtype).encode().ljust(8) + len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return bucket, kind, zstandard.compress(raw, 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def batch_of(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


def split_by(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, its parts of the arrays) for every bucket; order within a bucket is kept."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[a]]), [x[order[a:b]] for x in arrays]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the GRAM bytes from each place on."""
    m = np.uint64(MULTIPLIER)
    h, power, have, parts = data.astype(np.uint64) + np.uint64(1), m, 1, []
    left = GRAM
    while True:
        if left & have:
            parts.append((have, h, power))
        if have * 2 > left:
            break
        h, power, have = h[:-have] * power + h[have:], power * power, have * 2
    n, at, out = len(data) - GRAM + 1, 0, np.zeros(len(data) - GRAM + 1, np.uint64)
    for size, h, power in reversed(parts):
        out = out * power + h[at : at + n]
        at += size
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchor_runs(data: np.ndarray, valid: np.ndarray):
    """(hash, anchor place, first window, windows) of each anchor; valid tells which windows count."""
    h = gram_hashes(data)
    value, place, have, reach = h, np.arange(len(h), dtype=np.int32), 1, LENGTH - GRAM + 1
    while have < reach:
        step = min(have, reach - have)
        left, right = value[:-step], value[step:]
        take = right < left
        value, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        have += step
    s = np.flatnonzero(valid)
    if not len(s):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    p = place[s]
    first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
    return h[p[first]], p[first].astype(np.int64), s[first], np.diff(np.append(first, len(s)))


def pieces_of(docs):
    """Batches of about PIECE bytes: (data, valid windows, place of each document's piece, its document, its offset); docs yields (number, bytes)."""
    held, size = [], 0
    for d, text in docs:
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                held.append((d, at, part))
                size += len(part)
            if size >= PIECE:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held):
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in held])
    valid = np.ones(len(data) - LENGTH + 1, bool)
    for e in ends[:-1]:
        valid[max(0, e - LENGTH + 1) : e] = False
    starts = np.concatenate([[0], ends[:-1]])
    return data, valid, starts, np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])


def anchors_of(docs):
    """(hash, document, place in it, first window in it, windows, data, first window in data) of each batch of pieces."""
    for data, valid, starts, doc, offset in pieces_of(docs):
        h, place, first, n = anchor_runs(data, valid)
        k = np.searchsorted(starts, first, side="right") - 1
        shift = offset[k] - starts[k]
        yield h, doc[k], place + shift, first + shift, n, data, first


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values.astype(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def packed_by_doc(buckets: int, doc: np.ndarray, alias: np.ndarray, *values: np.ndarray, kind: int = 0):
    """Rows of values by document, whose name (doc_id, hash of its text) is written once a row."""
    order = np.lexsort((alias, doc))
    doc, alias, *values = (x[order] for x in (doc, alias, *values))
    for b, (d, n, *v) in split_by(bucket_of(doc, buckets), doc, alias, *values):
        head = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(n) != 0)))
        yield row(b, kind, d[head], n[head], np.diff(np.append(head, len(d))).astype(np.uint32), *(x.astype(np.uint32) for x in v))


def unpack_by_doc(blob: bytes) -> list[np.ndarray]:
    doc, alias, count, *values = unpack(blob)
    return [np.repeat(doc, count), np.repeat(alias, count), *values]


def by_document(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """(key, alias, name): what all packed rows have of each document, as one blob a document."""

    def run(batches):
        parts = [unpack_by_doc(b.as_py()) for batch in batches for b in batch.column(2)]
        if parts:
            doc, alias, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((alias, doc))
            doc, alias, values = doc[order], alias[order], [v[order] for v in values]
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(alias) != 0))), len(doc))
            for at in range(0, len(cuts) - 1, 4096):
                few = cuts[at : at + 4097]
                yield pa.RecordBatch.from_arrays([pa.array(doc[few[:-1]]), pa.array(alias[few[:-1]]), pa.array([b"".join(v[a:b].tobytes() for v in values) for a, b in zip(few, few[1:])], pa.binary())], ["key", "key_alias", name])

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, f"key long, key_alias long, {name} binary")


class Names:
    """The documents that a task holds something of, by number."""

    def __init__(self):
        self.doc, self.alias = [], []

    def add(self, doc: int, alias: int) -> int:
        self.doc.append(doc)
        self.alias.append(alias)
        return len(self.doc) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.doc, np.int64), np.array(self.alias, np.int64)


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of the places of anchors that another document may have too (kind 0), and of crowded anchors (kind 2)."""
    import zstandard  # noqa: F401  (fails early where it is missing)

    def send(held, names):
        doc_of, alias_of = names.arrays()
        h, k, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, k, doc_of[k], h))
        h, k, place = h[order], k[order], place[order]
        doc = doc_of[k]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        size = np.diff(np.append(first, len(h)))
        low, high = doc[first], doc[first + size - 1]
        here = np.repeat(low != high, size)  # shared within what is held: its places are known, one goes on for the rest
        sent = ~here
        sent[first] = True
        times = np.where(here, np.repeat(size, size), 0)[sent].astype(np.uint32)
        for b, (x, d, p, n) in split_by(((h[sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), h[sent].astype(np.uint32), k[sent], place[sent].astype(np.uint32), times):
            own, at = np.unique(d, return_inverse=True)
            yield row(b, 0, x, doc_of[own], alias_of[own], at.astype(np.uint32), p, n)
        if here.any():
            for r in packed_by_doc(buckets, doc[here], alias_of[k[here]], place[here], kind=1):
                yield r

    def scan(batches):
        held, size, names = [], 0, Names()
        for batch in batches:
            rows = zip((names.add(d, a) for d, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), (t.as_py() for t in batch.column(1)), strict=True)
            for h, k, place, _, _, _, _ in anchors_of(rows):
                held.append((h, k, place))
                size += len(h)
                if size >= HELD:
                    yield batch_of(list(send(held, names)))
                    held, size = [], 0
            if size >= HELD // 2:
                yield batch_of(list(send(held, names)))
                held, size, names = [], 0, Names()
        if held:
            yield batch_of(list(send(held, names)))

    def meet(batches):
        parts = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    yield batch_of(list(packed_by_doc(buckets, *unpack_by_doc(blob.as_py()))))
                else:
                    x, doc, alias, at, p, n = unpack(blob.as_py())
                    parts.append((x, doc[at], alias[at], p, n))
        if parts:
            x, doc, alias, place, times = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, x))
            x, doc, alias, place, times = (c[order] for c in (x, doc, alias, place, times))
            first = np.flatnonzero(np.diff(x.astype(np.int64), prepend=-1) != 0)
            size = np.diff(np.append(first, len(x)))
            known = times > 0
            shared = np.repeat((doc[first] != doc[first + size - 1]) | np.logical_or.reduceat(known, first), size)
            if shared.any():
                yield batch_of(list(packed_by_doc(buckets, doc[shared], alias[shared], place[shared])))
            occurs = np.add.reduceat(np.maximum(times, 1).astype(np.int64), first)
            crowded = x[first][occurs > max(CROWD, int(occurs.sum()) // 8)]
            if len(crowded):
                yield batch_of([row(0, 2, crowded)])

    return docs.mapInArrow(scan, ROWS).repartitionById(buckets, F.col("bucket")).mapInArrow(meet, ROWS)


def multikey_quicksort(words: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int, fresh: np.ndarray):
    """Sort the ranges of ``order`` by their suffixes' first ``limit`` characters; returns the ranges that are still equal.

    Every range is parted in three around the median of its first, middle and last character: what is equal goes on with
    the next character, the others with the same one. All open ranges take a step together. Starts of parts are marked
    in ``fresh``.
    """
    depth, left = np.zeros(len(start), np.int64), []
    while len(start):
        g = np.repeat(np.arange(len(start)), size)
        pos = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size) + start[g]
        pick = np.sort(np.stack([words[order[start + at], depth] for at in (0 * size, size // 2, size - 1)]), axis=0)[1]
        key, pivot = words[order[pos], depth[g]], pick[g]
        side = g * 3 + (key == pivot) + 2 * (key > pivot)
        by = np.argsort(side, kind="stable")
        order[pos], side = order[pos][by], side[by]
        head = np.flatnonzero(np.diff(side, prepend=-1))
        size = np.diff(np.append(head, len(side)))
        start, depth = pos[head], depth[side[head] // 3] + (side[head] % 3 == 1)
        fresh[start] = True
        many, done = size > 1, depth >= limit
        left.append((start[many & done], size[many & done]))
        start, size, depth = start[many & ~done], size[many & ~done], depth[many & ~done]
    return tuple(np.concatenate(c) for c in zip(*left, strict=True)) if left else (start, size)


class BlindTries:
    """Tries over the suffixes of ranges of ``order``, which they sort: a node holds a range, and the first character in
    which its members differ (-1: in none, they are equal); its children share theirs. Nodes are made level by level.
    """

    def __init__(self, words: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray):
        nodes, parent, made = [], np.full(len(start), -1, np.int64), 0
        while len(start):
            g = np.repeat(np.arange(len(start)), size)
            pos = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size) + start[g]
            rest, first = words[order[pos]], np.cumsum(size) - size
            differ = np.maximum.reduceat(rest, first, axis=0) != np.minimum.reduceat(rest, first, axis=0)
            branch = np.where(differ.any(axis=1), differ.argmax(axis=1), -1)
            nodes.append((start, size, branch, parent))
            goes = branch[g] >= 0
            g, pos = g[goes], pos[goes]
            key = rest[goes][np.arange(len(g)), branch[g]]
            by = np.lexsort((key, g))
            order[pos], key = order[pos][by], key[by]
            head = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (key[1:] != key[:-1]))) if len(g) else np.zeros(0, np.int64)
            parent, made = made + g[head], made + len(start)
            start, size = pos[head], np.diff(np.append(head, len(g)))
        self.start, self.size, self.branch, self.parent = (np.concatenate(c) for c in zip(*nodes, strict=True)) if nodes else (start, size, start, parent)


def deep_shallow(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes in order, the class of each): groups in turn, each sorted; a class is equal suffixes of a group, numbered in order."""
    order = np.argsort(group, kind="stable")
    fresh = np.append(True, np.diff(group[order]) != 0)[: len(order)]
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(order)))
    many = size > 1
    start, size = multikey_quicksort(words, order, start[many], size[many], min(SHALLOW, words.shape[1]), fresh)
    fresh[BlindTries(words, order, start, size).start] = True
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(fresh) - 1
    return order, cls


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each place on, as big-endian eight-byte characters; the last one is cut to length."""
    data = np.append(data, np.zeros(8, np.uint8))
    be = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        be = (be << np.uint64(8)) | data[i : len(data) - 7 + i]
    out = np.empty((len(at), -(-LENGTH // 8)), np.uint64)
    for k in range(out.shape[1]):
        take = min(8, LENGTH - 8 * k)
        out[:, k] = be[np.minimum(at + 8 * k, len(be) - 1)] >> np.uint64(8 * (8 - take)) if take < 8 else be[at + 8 * k]
    return out


def repeated_windows(h, doc, lead, contents: list[bytes]):
    """(segment, first window, windows) runs to remove among different segments; each comes with its smallest document."""
    order = np.argsort(h, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]) != 0), len(order))
    wide = np.flatnonzero(np.diff(cuts) > 1)
    at = 0
    while at < len(wide):
        some, size = [], 0
        while at < len(wide) and size < 1 << 19:
            members = order[cuts[wide[at]] : cuts[wide[at] + 1]]
            some.append(members)
            size += int(sum(len(contents[k]) - LENGTH + 1 for k in members))
            at += 1
        seg = np.concatenate(some)
        lens = np.array([len(contents[k]) for k in seg])
        data = np.frombuffer(b"".join([contents[k] for k in seg]), np.uint8)
        n = lens - LENGTH + 1
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(seg, n)
        anchor = np.repeat(np.repeat(np.arange(len(some)), [len(s) for s in some]), n)
        group = anchor * LENGTH + lead[own] - j  # equal windows have their anchor at the same place
        _, cls = deep_shallow(characters(data, np.repeat(np.cumsum(lens) - lens, n) + j), group)
        least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc[own])
        gone = np.flatnonzero(least[cls] < doc[own])
        if len(gone):
            first = np.flatnonzero((np.diff(own[gone], prepend=-1) != 0) | (np.diff(gone, prepend=-2) != 1))
            yield own[gone[first]], j[gone[first]], np.diff(np.append(first, len(gone)))


def occurrences(known) -> list[int]:
    return known[3] if isinstance(known[3], list) else [known[3]]


def send_segments(held: dict, gone: list, names: Names, buckets: int, crowded: np.ndarray):
    """Rows of what is held: segments by anchor, those of crowded anchors as windows by themselves."""
    from xxhash import xxh64_intdigest

    rows, windows = [], {}
    for c, known in held.items():
        if is_crowded(known[1], crowded):
            for j in range(len(c) - LENGTH + 1):
                for o in occurrences(known):
                    keep_least(windows, gone, c[j : j + LENGTH], known[0], 0, 0, o + j)
        else:
            rows += [(c, o, known[1], known[2]) for o in occurrences(known)]
    for c, known in windows.items():
        h = xxh64_intdigest(c, 1)  # an anchor of its own
        rows += [(c, o, h, 0) for o in occurrences(known)]
    doc, alias = names.arrays()
    if rows:
        content, own, h, lead = zip(*rows, strict=True)
        h, own, lead = np.array(h, np.uint64), np.array(own, np.int64), np.array(lead, np.uint8)
        for b, (k,) in split_by(bucket_of(h, buckets), np.arange(len(h))):
            few = [content[i] for i in k]
            number, at = np.unique(own[k] >> 32, return_inverse=True)
            yield row(b, 0, h[k], doc[number], alias[number], at.astype(np.uint32), (own[k] & 0xFFFFFFFF).astype(np.uint32), lead[k], np.array([len(c) for c in few], np.uint8), np.frombuffer(b"".join(few), np.uint8))
    if gone:
        yield from packed_gone(gone, names, buckets, kind=1)


def packed_gone(gone: list[tuple[int, int]], names: Names, buckets: int, kind: int = 0):
    doc, alias = names.arrays()
    own, n = (np.array(c, np.int64) for c in zip(*gone, strict=True))
    return packed_by_doc(buckets, doc[own >> 32], alias[own >> 32], own & 0xFFFFFFFF, n, kind=kind)


def is_crowded(h: int, crowded: np.ndarray) -> bool:
    """crowded: the lower halves of the crowded anchors' hashes, in order."""
    at = np.searchsorted(crowded, np.uint32(h & 0xFFFFFFFF)) if len(crowded) else 0
    return at < len(crowded) and crowded[at] == np.uint32(h & 0xFFFFFFFF)


def segment_rows(docs: DataFrame, places: DataFrame, buckets: int, crowded: np.ndarray) -> DataFrame:
    """Packed rows of segments by anchor (kind 0) and of windows to remove (kind 1)."""
    given = docs.sparkSession.sparkContext.broadcast(crowded)

    def cut(batches):
        held: dict[bytes, list] = {}
        gone: list[tuple[int, int]] = []
        names = Names()
        for batch in batches:
            ids, base = batch.column(0).to_pylist(), len(names.doc)
            for d, a in zip(ids, batch.column(2).to_pylist(), strict=True):
                names.add(d, a)
            wanted = [np.frombuffer(p.as_py(), np.uint32) for p in batch.column(3)]
            for h, k, place, first, n, data, at in anchors_of(enumerate(t.as_py() for t in batch.column(1))):
                shared = np.zeros(len(h), bool)
                for x in np.unique(k):
                    mine = np.flatnonzero(k == x) if len(k) < 64 else np.arange(*np.searchsorted(k, [x, x + 1]))
                    shared[mine] = np.isin(place[mine], wanted[x])
                raw = data.tobytes()
                s = np.flatnonzero(shared)
                for hh, d, lead, start, m, a in zip(h[s].tolist(), k[s].tolist(), (place - first)[s].tolist(), first[s].tolist(), n[s].tolist(), at[s].tolist()):
                    keep_least(held, gone, raw[a : a + m + LENGTH - 1], ids[d], hh, lead, base + d << 32 | start)
            if len(held) + len(gone) >= HELD_SEGMENTS:
                yield batch_of(list(send_segments(held, gone, names, buckets, given.value)))
                held, gone, names = {}, [], Names()
        if held or gone:
            yield batch_of(list(send_segments(held, gone, names, buckets, given.value)))

    return docs.join(places, (docs["doc_id"] == places["key"]) & (docs["alias"] == places["key_alias"])).select("doc_id", "text", "alias", "places").mapInArrow(cut, ROWS)


def keep_least(held, gone, content, doc, h, lead, own):
    """Among equal segments those of the smallest document stay held; the others' windows go.

    own: where the segment is, its document's number and its first window in one integer.
    """
    known = held.get(content)
    if known is None:
        held[content] = [doc, h, lead, own]
    elif known[0] == doc:
        known[3] = [*occurrences(known), own] if not isinstance(known[3], list) else known[3]
        if known[3][-1] != own:
            known[3].append(own)
    elif known[0] < doc:
        gone.append((own, len(content) - LENGTH + 1))
    else:
        gone += [(o, len(content) - LENGTH + 1) for o in occurrences(known)]
        known[0], known[3] = doc, own


def removed_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, key_alias, gone): by document the runs of windows to remove, all first windows and then all lengths."""

    def meet(batches):
        held: dict[bytes, list] = {}
        gone: list[tuple[int, int]] = []
        names = Names()
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    yield batch_of(list(packed_by_doc(buckets, *unpack_by_doc(blob.as_py()))))
                    continue
                h, doc, alias, at, start, lead, lens, data = unpack(blob.as_py())
                base, ids = len(names.doc), doc[at]
                for d, a in zip(doc.tolist(), alias.tolist(), strict=True):
                    names.add(d, a)
                own = (at.astype(np.int64) + base << 32) | start
                raw, ends = data.tobytes(), np.cumsum(lens, dtype=np.int64).tolist()
                for a, b, d, x, v, o in zip([0, *ends], ends, ids.tolist(), h.tolist(), lead.tolist(), own.tolist()):
                    keep_least(held, gone, raw[a:b], d, x, v, o)
        if held:
            contents = list(held)
            doc, h, lead, _ = zip(*held.values(), strict=True)
            doc = np.array(doc, np.int64)
            for seg, first, n in repeated_windows(np.array(h, np.uint64), doc, np.array(lead, np.int64), contents):
                gone += [(o + f, m) for k, f, m in zip(seg.tolist(), first.tolist(), n.tolist()) for o in occurrences(held[contents[k]])]
        if gone:
            yield batch_of(list(packed_gone(gone, names, buckets)))

    met = materialize(shared_anchors(docs, buckets), "anchors")
    listed = [unpack(bytes(r[0]))[0] for r in met.where("kind = 2").select("blob").collect()]  # at most eight anchors a bucket
    crowded = np.unique(np.concatenate(listed)) if listed else np.zeros(0, np.uint32)
    places = by_document(met.where("kind <> 2"), buckets, "places")
    rows = segment_rows(docs, places, buckets, crowded)
    return by_document(rows.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, ROWS), buckets, "gone")


def cover(n: int, gone: bytes | None):
    """(starts, ends) of the maximal runs of bytes under the removed windows of a text of n bytes."""
    if not gone:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, many = np.frombuffer(gone, np.uint32).astype(np.int64).reshape(2, -1)
    order = np.argsort(first)
    a, b = first[order], np.maximum.accumulate((first + many + LENGTH - 1)[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def deduplicate(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the runs of removed bytes as (start, end) pairs, and the bytes that stay."""
    buckets = buckets or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = texts(documents).select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("alias"))
    gone = removed_windows(docs, buckets)

    def run(batches):
        for batch in batches:
            out = []
            for doc, t, g in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = t.as_py()
                a, b = cover(len(text), g.as_py())
                kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                out.append((doc, len(text), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], kept))
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    # both joins deal out the same texts by doc_id and alias, so the plan has that shuffle once
    return docs.join(gone, (docs["doc_id"] == gone["key"]) & (docs["alias"] == gone["key_alias"]), "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(deduplicated: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return deduplicated.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
