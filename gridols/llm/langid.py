"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER`` with the byte counts of its training texts. A byte's code
length is that of its longest context, or the escape's there and then that of the next shorter context (escape method
C: a context seen T times before D distinct bytes escapes with D / (T + D); below order 0 all 256 bytes are alike).
Statistics are frozen: a text's code lengths are exact sums over all its bytes, and the language with the shortest
code is predicted, of equal codes the alphabetically first one. The trees are fitted on a bounded sample: of each language at
most ``sample_docs`` whole documents, chosen by the hash of the doc_id; of a doc_id with several rows one is learned from.

Nothing is known of a text but its bytes: a language that has only long documents is learned from them whole.

For speed, the trees of all languages are merged into one table of byte grams for each order, whose rows hold the
exact code length of the gram's last byte in every language; most bytes then take a single look-up. The tables have four
bytes a sampled gram and language, so a corpus of very many languages wants a smaller sample of each.

Nulls and the like: a null text, and one without a letter (of the Unicode categories L: digits, number
signs, marks and symbols are none), is ``und`` with score 0; rows with a null lang are not
learned from; rows without a doc_id are left out; repeated rows get a row each; if nothing can be learned from, all
is ``und``; columns other than doc_id, text and lang are not read, and ``keep_known`` keeps columns of any name; long texts
are scored whole, in pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridols.llm.common import fold, hashed_sample, texts, without

ORDER = 4
PAD = b"\n" * ORDER
LETTER = r"\p{L}"


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 bytes that end at each byte from ORDER on, as integers; data starts with ORDER bytes of context."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(ORDER - k, ORDER + 1):
        out = (out << np.uint64(8)) | data[i : len(data) - ORDER + i]
    return out


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Index:
    """Open-addressing hash table from unsigned 64-bit keys to their places."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self.hash(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def hash(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self.hash(keys)
        at = self.slots[slot]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return at


class Model:
    """Code lengths in bits, for all languages, of the byte grams of each order, and of escapes from each context."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """counts: by order, arrays of gram, place of the language in langs, count."""
        self.langs, self.tables = langs, []
        below_find, below_cost = None, None
        for k in range(ORDER + 1):
            gram, lang, n = counts[k]
            keys, at = np.unique(gram, return_inverse=True)
            seen = np.zeros((len(keys), len(langs)))
            seen[at, lang] = n
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(seen / (total + kinds)[of])
            shorter = keys & np.uint64((1 << (8 * k)) - 1)
            lower = np.full((len(keys), len(langs)), 8.0) if k == 0 else below_cost[below_find(shorter)]
            cost = np.where(seen > 0, hit, escape[of] + lower)
            index = Index(keys)
            self.tables.append((index, cost.astype(np.float32), Index(contexts), escape.astype(np.float32)))
            below_find, below_cost = index.find, cost

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte from ORDER on, in every language."""
        out = np.zeros((len(data) - ORDER, len(self.langs)), np.float32)
        left = None
        for k in range(ORDER, -1, -1):
            index, cost, contexts, escape = self.tables[k]
            g = grams(data, k)
            g = g if left is None else g[left]
            at = index.find(g)
            found = at >= 0
            if left is None:
                out[found] = cost[at[found]]
            else:
                out[left[found]] += cost[at[found]]
            miss = np.flatnonzero(~found)
            left = miss if left is None else left[miss]
            if not len(left):
                return out
            at = contexts.find(g[miss] >> np.uint64(8))
            out[left[at >= 0]] += escape[at[at >= 0]]
        out[left] += 8.0
        return out

    def score(self, batch: list[bytes], piece: int | None = None) -> np.ndarray:
        """Total code lengths of whole texts, a row each."""
        piece = piece or (1 << 22) // len(self.langs)
        total = np.zeros((len(batch), len(self.langs)))
        held, owners, size = [], [], 0
        for i, b in enumerate(batch):
            b = PAD + b
            for at in range(0, len(b) - ORDER, piece):
                part = b[at : at + piece + ORDER]
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= piece:
                    self.flush(held, owners, total)
                    held, owners, size = [], [], 0
        self.flush(held, owners, total)
        return total

    def flush(self, held, owners, total):
        if held:
            bits = np.pad(self.bits(np.frombuffer(b"".join(held), np.uint8)), ((0, 1), (0, 0)))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
            ends = starts + [len(x) - ORDER for x in held]  # the context bytes of the next piece count for nobody
            sums = np.add.reduceat(bits, np.stack([starts, ends], 1).ravel(), axis=0, dtype=np.float64)[::2]
            np.add.at(total, owners, sums)


def training_counts(documents: DataFrame, learn: Column, sample_docs: int) -> DataFrame:
    """(lang, k, gram, n) over the sample of the labelled documents that ``learn`` admits."""
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn & (F.octet_length("text") > 0))
    ids = labelled.select("lang", "doc_id").distinct()
    chosen = hashed_sample(ids, "lang", sample_docs)  # at most sample_docs rows a language
    one = labelled.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data = [prepared(t) for t in batch.column(1).to_pylist()]
            for lang in set(langs):
                for k in range(ORDER + 1):
                    found = [grams(np.frombuffer(PAD + d, np.uint8), k) for d, x in zip(data, langs, strict=True) if x == lang]
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "k", "gram", "n"])

    return one.select("lang", "text").mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, learn: Column | None = None, sample_docs: int = 300) -> Model | None:
    """The frozen model; what reaches the driver is bounded by the sample."""
    t = training_counts(documents, F.lit(True) if learn is None else learn, sample_docs).toArrow()
    if not t.num_rows:
        return None
    langs = sorted(set(t.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in t.column("lang").to_pylist()])
    k, gram, n = (t.column(c).to_numpy() for c in ("k", "gram", "n"))
    return Model(langs, {i: (gram[k == i].astype(np.uint64), lang[k == i], n[k == i]) for i in range(ORDER + 1)})


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte); score is the share of the predicted language among all code lengths' likelihoods."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        model, letter = held.value, regex.compile(LETTER)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            told = [i for i, t in enumerate(raw) if model is not None and t and letter.search(t)]
            lang, score, rate = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            if told:
                data = [prepared(raw[i]) for i in told]
                bits = model.score(data)
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(told)), best]
                score[told] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                rate[told] = low / [len(d) for d in data]
                for i, b in zip(told, best, strict=True):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return texts(documents).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def identify(documents: DataFrame, sample_docs: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte), learned from the documents that are not held out."""
    held_out = fold(4) == 2
    return predict(documents, fit(documents, ~held_out, sample_docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_known(documents: DataFrame, max_bits: float = 8.0, sample_docs: int = 300) -> DataFrame:
    """The documents without those that no language explains: ``und``, or a code no shorter than the bytes themselves."""
    found = predict(documents, fit(documents, None, sample_docs))
    return without(documents, found.where((F.col("lang_pred") == "und") | (F.col("bits_per_byte") >= max_bits)))
