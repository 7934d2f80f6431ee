"""Exact removal of repeated 50-word passages across documents, by automata over recurring phrases.

A word goes if a window of ``LENGTH`` words over it also starts in a document with a smaller doc_id. Words are compared, not
hashes; hashes only say where to look.

1. Candidates. Each window has an anchor, the leftmost of its 20-word grams with the least hash; equal windows have equal
   anchors. Consecutive windows of one anchor make a run. Runs (two hashes, a document and a place) are aggregated by
   anchor: those of one document only are done with.
2. Confirmed passages. Runs of equal hash are one content, whose words are fetched once, from its smallest document. An anchor
   with one content has a passage, the whole run. Where an anchor has several contents, their windows are aggregated by
   anchor and digest, which gives each window's smallest document (its owner) and largest one; consecutive windows of a content
   that recur and have the same owner make a passage.
3. Automata. Anchors are put in shards by where their first document has them (``REACH`` words of a document a shard), so what a
   document copies from another stays in one piece. A shard whose anchors cover much text gets several automata, each for
   its share of the documents. Every document's stretches of live anchors stream past the automaton of their shard, which
   finds every occurrence of its passages; those in documents after the owner are removed.

What one key may have much of is aggregated before it is shuffled (runs, contents, windows), dealt over salts (stretches),
or joined where skewed partitions can be split (runs with live anchors).

Nulls and the like: a null, empty or blank text has no words; texts shorter than ``LENGTH`` words keep all; rows without a
doc_id are left out; rows of one doc_id get a row each and do not remove from each other, while each of them removes from
larger doc_ids; a passage stays in its smallest document, however often it stands there; words are told apart as they are,
upper and lower case, and blanks between them do not matter; columns of other names are not read; an empty table gives an
empty result. Very long texts are worked on in pieces that overlap, and treated whole; a very long word is one word.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import materialize, texts
from gridols.llm.suffixes import LENGTH, MULTIPLIER, anchor_runs

PIECE = 1 << 20
#: Words of the first document whose anchors share a shard; windows of the text that an automaton is to read; words of a stretch.
REACH, SHARE, STRETCH = 4096, 1 << 20, 4096
BLANKS = re.compile(rb"[\x20\x09-\x0d]")
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
RUNS = "a long, h long, doc long, alias long, at int, n int"
CUT = "kind int, key long, salt int, a long, h long, lo long, hi long, alias long, start int, words binary"


@cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of every word."""
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = byte_values()[data[place + np.repeat(starts, size)]] * powers(MULTIPLIER, int(size.max(initial=0)))[place]
    h = np.add.reduceat(letters, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def pieces_of(docs):
    """Lists of (number, words before it, bytes) of about PIECE bytes; docs yields (number, bytes), and long ones come in pieces that share LENGTH - 1 words."""
    held, size = [], 0
    for d, text in docs:
        at = before = 0
        reach = PIECE
        while True:
            cut = BLANKS.search(text, at + reach) if at + reach < len(text) else None
            end = cut.start() if cut else len(text)
            part = text[at:end]
            starts = word_spans(np.frombuffer(part, np.uint8))[0] if end < len(text) else None
            if starts is not None and len(starts) < 2 * LENGTH:
                reach *= 2  # very long words
                continue
            held.append((d, before, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
            if starts is None:
                break
            at, before, reach = at + int(starts[1 - LENGTH]), before + len(starts) + 1 - LENGTH, PIECE
    if held:
        yield held


def runs_of(docs):
    """(anchor, hash of the words, number, first window, windows) of the runs of each list of pieces."""
    for held in pieces_of(docs):
        data = np.frombuffer(b" ".join(p for _, _, p in held), np.uint8)
        starts, ends = word_spans(data)
        if len(starts) < LENGTH:
            continue
        heads = np.cumsum([0] + [len(p) + 1 for _, _, p in held[:-1]])
        piece = np.searchsorted(heads, starts, side="right") - 1
        words = word_hashes(data, starts, ends)
        a, _, first, n = anchor_runs(words, piece[: 1 - LENGTH] == piece[LENGTH - 1 :])
        sums = np.append(np.uint64(0), np.cumsum(words * powers(MULTIPLIER, len(words)), dtype=np.uint64))
        h = (sums[first + n + LENGTH - 1] - sums[first]) * powers(INVERSE, len(words))[first]
        h ^= h >> np.uint64(32)
        own = piece[first]
        shift = np.array([b for _, b, _ in held]) - np.searchsorted(piece, np.arange(len(held)))
        yield a, h * np.uint64(MULTIPLIER), np.array([d for d, _, _ in held])[own], first + shift[own], n


def runs(docs: DataFrame) -> DataFrame:
    """RUNS of all documents."""

    def scan(batches):
        for b in batches:
            doc, alias = b.column(0).to_numpy(), b.column(2).to_numpy()
            for a, h, k, at, n in runs_of(enumerate(t.as_py() for t in b.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), pa.array(doc[k]), pa.array(alias[k]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "h", "doc", "alias", "at", "n"])

    return docs.mapInArrow(scan, RUNS)


def stretches(told: list[dict]):
    """(key, salts, first window, windows): neighbouring runs of one shard together."""
    out = None
    for t in sorted(told, key=lambda t: t["at"]):
        if out and t["key"] == out[0] and t["at"] == out[2] + out[3] and out[3] < STRETCH:
            out[3] += t["n"]
        else:
            if out:
                yield out
            out = [t["key"], t["salts"], t["at"], t["n"]]
    if out:
        yield out


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """CUT: the words of contents (kind 0 with one content for the anchor, kind 1 with several) and of stretches (kind 2)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, alias, told in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text.as_py()
                starts, ends = word_spans(np.frombuffer(text, np.uint8))
                words = lambda at, n: b" ".join(text[starts[at] : ends[at + n + LENGTH - 2]].split())  # noqa: B023, E731
                for t in told:
                    if t["kind"] < 2:
                        rows += [(t["kind"], t["key"], s, t["a"], t["h"], doc, t["hi"], alias, t["at"], words(t["at"], t["n"])) for s in range(t["salts"] if t["kind"] == 0 else 1)]
                for key, salts, at, n in stretches([t for t in told if t["kind"] == 2]):
                    rows.append((2, key, (alias ^ doc ^ at // STRETCH) % salts, 0, 0, doc, 0, alias, at, words(at, n)))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows):
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "key", "salt", "a", "h", "lo", "hi", "alias", "start", "words"])

    told = wanted.groupBy(F.col("doc").alias("key"), F.col("alias").alias("key_alias")).agg(F.collect_list("told").alias("told"))
    return docs.join(told, (docs["doc_id"] == told["key"]) & (docs["alias"] == told["key_alias"])).select("doc_id", "text", "alias", "told").mapInArrow(run, CUT)


def owned_runs(contents: DataFrame, salts: DataFrame) -> DataFrame:
    """(key, salt, owner, words): passages of contents whose anchor has several, by the owners of their windows."""

    def windows(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            for a, h, lo, hi, words in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                spans = [m.span() for m in re.finditer(rb"[^ ]+", words)]
                n = len(spans) - LENGTH + 1
                digests = np.array([xxh3_64_intdigest(words[spans[j][0] : spans[j + LENGTH - 1][1]]) for j in range(n)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), *(pa.array([v] * n, pa.int64()) for v in (a, h, lo, hi)), pa.array(range(n), pa.int32())], ["w", "a", "h", "lo", "hi", "j"])

    each = materialize(contents.select("a", "h", "lo", "hi", "words").mapInArrow(windows, "w long, a long, h long, lo long, hi long, j int"), "windows")
    owners = each.groupBy(F.col("a").alias("own_a"), F.col("w").alias("own_w")).agg(F.min("lo").alias("owner"), F.max("hi").alias("last")).where("owner < last").drop("last")
    owners = materialize(owners, "owners")
    needed = each.join(owners, (each["a"] == owners["own_a"]) & (each["w"] == owners["own_w"])).where("owner < hi")
    told = needed.groupBy(F.col("a").alias("of_a"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("j", "owner")).alias("told"))

    def passages(batches):
        for b in batches:
            rows = []
            for key, words, told in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words, begun = words.split(b" "), None
                for j, owner in sorted((t["j"], t["owner"]) for t in told):
                    if begun and begun[1] == owner and j == begun[0] + begun[2]:
                        begun[2] += 1
                        continue
                    if begun:
                        rows.append((key, begun[1], b" ".join(words[begun[0] : begun[0] + begun[2] + LENGTH - 1])))
                    begun = [j, owner, 1]
                rows.append((key, begun[1], b" ".join(words[begun[0] : begun[0] + begun[2] + LENGTH - 1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "owner", "words"])

    one = contents.join(told, (contents["a"] == told["of_a"]) & (contents["h"] == told["of_h"])).select("key", "words", "told")
    found = one.mapInArrow(passages, "key long, owner long, words binary").distinct()
    dealt = found.join(salts.select(F.col("key").alias("of_key"), "salts"), F.col("key") == F.col("of_key"))
    return dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "owner", "words")


class Automaton:
    """Finds passages, given as words, in stretches of words; each word of the passages is a letter of the automaton."""

    def __init__(self):
        import ahocorasick

        self.letter: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def add(self, words: list[bytes], owner: int) -> None:
        self.machine.add_word(tuple(self.letter.setdefault(w, len(self.letter) + 1) for w in words), (len(words), owner))

    def removed(self, words: list[bytes], doc: int) -> list[list[int]]:
        """(first word, word behind the last) of what passages of smaller documents cover, in order, apart."""
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        found = sorted((end + 1 - n, end + 1) for end, (n, owner) in self.machine.iter(tuple(self.letter.get(w, 0) for w in words)) if owner < doc)
        out: list[list[int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out


def occurrences(passages: DataFrame, texts_of: DataFrame) -> DataFrame:
    """(doc, alias, first, last): removed words, as every shard's automaton finds them in its stretches."""

    def run(batches):
        shard, machine = None, None
        for b in batches:
            out = []
            for key, salt, kind, owner, alias, start, words in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (key, salt) != shard:
                    shard, machine = (key, salt), Automaton()
                words = words.split(b" ")
                if kind == 0:
                    machine.add(words, owner)
                elif machine.letter:
                    out += [(owner, alias, start + x, start + y) for x, y in machine.removed(words, owner)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "alias", "first", "last"])

    first = passages.select("key", "salt", F.lit(0).alias("kind"), "owner", F.lit(0).cast("long").alias("alias"), F.lit(0).alias("start"), "words")
    then = texts_of.select("key", "salt", F.lit(1).alias("kind"), F.col("lo").alias("owner"), "alias", "start", "words")
    return first.unionByName(then).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind").mapInArrow(run, "doc long, alias long, first int, last int")


def without_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """(number of words, the words outside of the spans joined by one space)."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    stays = np.ones(len(starts), bool)
    for a, b in spans:
        stays[a:b] = False
    size = (ends - starts + 1)[stays]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[stays], size)
    out = np.append(data, np.uint8(32))[place]
    out[np.cumsum(size) - 1] = 32  # each word comes with the blank behind it
    return len(starts), out[:-1].tobytes()


def deduplicate(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, kept): the removed words as (start, end) pairs of word numbers, and the words that stay, joined by one space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = texts(documents).select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("alias"))
    every = runs(docs)  # read from the texts twice: that costs less than to keep all runs
    live = every.groupBy(F.col("a").alias("of_a")).agg(F.min("doc").alias("lo"), F.max("doc").alias("last")).where("lo < last").drop("last")
    live = materialize(live, "recurring")  # a table, so that the join can split skewed partitions
    shared = materialize(every.join(live, every["a"] == live["of_a"]).drop("of_a"), "shared")

    contents = shared.groupBy("a", "h", "n").agg(F.min(F.struct("doc", "at", "alias")).alias("first"), F.max("doc").alias("hi"), F.count("*").alias("times"))
    contents = materialize(contents.select("a", "h", "n", "first.*", "hi", "times"), "contents")
    by_anchor = contents.groupBy(F.col("a").alias("of_a")).agg(F.min(F.struct("doc", "at")).alias("top"), F.count("*").alias("contents"), F.sum(F.col("n") * F.col("times")).alias("load"))
    by_anchor = by_anchor.select("of_a", F.xxhash64("top.doc", F.floor(F.col("top.at") / REACH)).alias("key"), (F.col("contents") > 1).cast("int").alias("kind"), "load")
    salts = by_anchor.groupBy(F.col("key").alias("of_key")).agg(F.ceil(F.sum("load") / SHARE).cast("int").alias("salts"))
    anchors = materialize(by_anchor.join(salts, by_anchor["key"] == salts["of_key"]).drop("of_key", "load"), "live")

    told = lambda kind, a, h, hi: F.struct(kind.alias("kind"), "at", "n", "key", "salts", a.alias("a"), h.alias("h"), hi.alias("hi"))
    zero = F.lit(0).cast("long")
    fetched = contents.join(anchors, contents["a"] == anchors["of_a"]).select("doc", "alias", told(F.col("kind"), F.col("a"), F.col("h"), F.col("hi")).alias("told"))
    routed = shared.where("doc > lo").join(anchors.drop("kind"), shared["a"] == anchors["of_a"]).select("doc", "alias", told(F.lit(2), zero, zero, zero).alias("told"))
    cut = materialize(cut_out(docs, fetched.unionByName(routed)), "cut", "kind")

    single = cut.where("kind = 0").select("key", "salt", F.col("lo").alias("owner"), "words")
    several = owned_runs(cut.where("kind = 1"), anchors.select("key", "salts").distinct())
    gone = occurrences(single.unionByName(several), cut.where("kind = 2"))
    by_doc = gone.groupBy(F.col("doc").alias("key"), F.col("alias").alias("key_alias")).agg(F.collect_list(F.struct("first", "last")).alias("gone"))

    def run(batches):
        for b in batches:
            out = []
            for doc, text, gone in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                spans: list[dict] = []
                for a, z in sorted((g["first"], g["last"]) for g in gone or []):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], z)
                    else:
                        spans.append({"start": a, "end": z})
                n, kept = without_words(text.as_py(), [(s["start"], s["end"]) for s in spans])
                out.append((doc, n, spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "spans", "kept"])

    joined = docs.join(by_doc, (docs["doc_id"] == by_doc["key"]) & (docs["alias"] == by_doc["key_alias"]), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary")


def digest(deduplicated: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
