"""Token-id files: documents compressed one by one with a shared zstandard dictionary, behind an offset index.

A blob holds consecutive documents in ascending doc_id order (all integers little-endian)::

    magic "GTID" | version u16 | id width u16 | n u32 | sha256 of the dictionary (32 bytes)
    doc ids i64[n] | token starts u64[n + 1] (within the shard) | frame offsets u64[n + 1] (within the frames)
    frames: one zstandard frame a document, over its serialized id array

Blobs lie in a table (shard, blob_no, first_doc, last_doc, blob); a shard is one range of doc_id, so one document is
reached by its shard's ranges, the index and one frame. The dictionary is trained on the serialized id arrays of a
bounded sample of documents and stored beside the blobs under its hash; a reader refuses any other.

A shard's ids are counted by the range that it holds, so shards may differ in size; ``spark.sql.shuffle.partitions`` or
``shards`` says how many there are.

Nulls and the like: a null text counts as empty, and an empty document is the end id alone; rows without a doc_id are
left out; repeated rows are separate documents, and documents of one doc_id lie in the order of their texts; an empty
table writes no blob and reads back as no rows. Texts are encoded whole, however long. Columns other than doc_id and text
are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridols.llm.common import shared_dir, texts

BLOB = "shard int, blob_no int, first_doc long, last_doc long, n_tokens long, blob binary"
HEAD = "<4sHHI32s"
#: Fixed value: a splitter's pattern whose matches hold no white space; all else is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a worker keeps.
CACHE_WORDS = 800_000


def splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words: it lowers case, keeps nothing of white space, and has no other step."""
    steps = lambda part, inner: (part or {}).get(inner, [part] if part else [])
    normal, split = steps(config["normalizer"], "normalizers"), steps(config["pre_tokenizer"], "pretokenizers")
    if {x["type"] for x in normal} - {"NFC", "Replace", "Lowercase"} or not any(x["type"] == "Lowercase" for x in normal):
        return False
    if any(x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": r"\s+"}, " ") for x in normal):
        return False
    if len(split) != 2 or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[1].get("use_regex", True) or split[1]["add_prefix_space"]:
        return False
    words_alone = split[0]["pattern"].get("Regex") == WORDS and split[0]["behavior"] == "Removed" and split[0]["invert"]
    return bool(words_alone) and config["model"]["type"] == "BPE" and not config["post_processor"] and all(x["content"].startswith("<|") for x in config["added_tokens"])


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct word where that is the same.

    If a vocabulary lowers case and its splitter drops white space (checked when it is read), no piece of it reaches over
    a space or line feed; so a text's ids are those of its words in turn, with A-Z lowered. Texts that may hold a special
    token go to the library whole, and so does every text if the vocabulary is not of this kind.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.by_words = splits_at_spaces(json.loads(self.tokenizer.to_str()))

    def whole(self, text: bytes) -> bool:
        return not self.by_words or b"<|" in text

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def many(self, batch: list[bytes | None], end: int) -> list[bytes]:
        """Serialized ids of each UTF-8 text, with the end id."""
        known = self.known
        flat, cuts = [], [0]
        for t in batch:
            flat += [] if not t or self.whole(t) else t.lower().replace(b"\n", b" ").split(b" ")
            cuts.append(len(flat))
        got = list(map(known.get, flat))
        missed = [i for i, v in enumerate(got) if v is None]
        fresh = dict.fromkeys([flat[i] for i in missed])
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), dtype=np.int64) * self.width
        packed = self.pack([i for x in ids for i in x])
        fresh = dict(zip(fresh, [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], strict=True))
        for i in missed:
            got[i] = fresh[flat[i]]
        if len(known) < CACHE_WORDS:
            known.update(fresh)
        last = self.pack([end])
        return [(self.pack(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids) if t and self.whole(t) else b"".join(got[a:b])) + last for t, a, b in zip(batch, cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    return _encoders.setdefault(path, _encoders.get(path) or WordEncoder(path))


def train_dictionary(documents: DataFrame, vocabulary: str, end: int, sample_docs: int, dict_bytes: int, piece_ids: int = 512) -> bytes:
    """A dictionary from at most ``sample_docs`` documents, chosen by the hash of their id.

    Whole texts are encoded where they lie and cut into pieces of ``piece_ids`` ids; of these, ``4 * sample_docs`` chosen by
    hash are the samples, so long documents are trained on as well, and what reaches the driver is bounded. Where the
    samples are too few or too alike to train on, their own bytes are the dictionary. An empty table has an empty one.
    """
    rows = texts(documents).select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    ids = [r[0] for r in rows.where("n > 0").select("h", "doc_id").orderBy("h", "doc_id").limit(sample_docs).select("doc_id").distinct().collect()]

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), enc.many(batch.column(1).to_pylist(), end), strict=True):
                cut = [data[at : at + piece_ids * enc.width] for at in range(0, len(data), piece_ids * enc.width)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["doc_id", "k", "piece"])

    chosen = texts(documents).where(F.col("doc_id").isin(ids)).select("doc_id", F.col("text").cast("binary")) if ids else None
    pieces = chosen.mapInArrow(run, "doc_id long, k int, piece binary").orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "piece").limit(4 * sample_docs).select("piece").collect() if ids else []
    return trained([bytes(r[0]) for r in pieces], dict_bytes)


def trained(samples: list[bytes], dict_bytes: int) -> bytes:
    import zstandard

    size = min(dict_bytes, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # a dictionary of plain content serves as well
        return b"".join(samples)[-size:].rjust(8, b"\0")


def write(documents: DataFrame, path: str, vocabulary: str, end: int = 2, shards: int | None = None, level: int = 3, sample_docs: int = 1000, dict_bytes: int = 65536, blob_docs: int = 2048, blob_bytes: int = 4 << 20) -> None:
    """Encode every document and write the files under ``path`` (blobs and dictionary)."""
    import zstandard

    spark = documents.sparkSession
    dictionary = train_dictionary(documents, vocabulary, end, sample_docs, dict_bytes)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        from pyspark import TaskContext

        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None)
        no, start, ids, counts, frames, size = 0, 0, [], [], [], 0

        def blob():
            nonlocal no, start, ids, counts, frames, size
            starts = start + np.concatenate([[0], np.cumsum(counts)])
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            data = struct.pack(HEAD, b"GTID", 1, enc.width, len(ids), digest) + np.array(ids, "<i8").tobytes() + starts.astype("<u8").tobytes() + offsets.astype("<u8").tobytes() + b"".join(frames)
            row = [[shard], [no], [ids[0]], [ids[-1]], [int(sum(counts))], [data]]
            no, start, ids, counts, frames, size = no + 1, int(starts[-1]), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "blob_no", "first_doc", "last_doc", "n_tokens", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc, data in zip(part.column(0).to_pylist(), enc.many(part.column(1).to_pylist(), end), strict=True):
                    frame = packer.compress(data)
                    ids.append(doc)
                    counts.append(len(data) // enc.width)
                    frames.append(frame)
                    size += len(frame)
                    if len(ids) >= blob_docs or size >= blob_bytes:
                        yield blob()
        if ids:
            yield blob()

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts(documents).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", F.col("text").cast("binary")).mapInArrow(run, BLOB).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blobs")


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    found = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(found["dictionary"])
    if hashlib.sha256(data).hexdigest() != found["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return data


def open_blob(blob: bytes, dictionary: bytes):
    """(doc ids, token starts, function from a document's place in the blob to its ids)."""
    import zstandard

    magic, version, width, n, digest = struct.unpack_from(HEAD, blob)
    if magic != b"GTID" or version != 1 or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token-id blob of this dictionary")
    at = struct.calcsize(HEAD)
    ids = np.frombuffer(blob, "<i8", n, at)
    starts = np.frombuffer(blob, "<u8", n + 1, at + 8 * n).astype(np.int64)
    offsets = np.frombuffer(blob, "<u8", n + 1, at + 8 * n + 8 * (n + 1)).astype(np.int64) + at + 8 * n + 16 * (n + 1)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(blob)
    return ids, starts, lambda i: np.frombuffer(unpacker.decompress(view[offsets[i] : offsets[i + 1]]), f"<u{width}")


def read_back(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    blobs = spark.read.schema(BLOB).parquet(f"{path}/blobs")
    totals = sorted((r[0], r[1]) for r in blobs.groupBy("shard").agg(F.sum("n_tokens")).collect())  # a row for each shard
    bases, at = {}, 0
    for shard, n in totals:
        bases[shard], at = at, at + n
    held = spark.sparkContext.broadcast((dictionary_of(spark, path), bases))

    def run(batches):
        dictionary, base = held.value
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, starts, get = open_blob(blob.as_py(), dictionary)
                arrays = [get(i).astype("<u4") for i in range(len(ids))]
                out = [pa.array(ids), pa.array(starts[:-1] + base[shard]), pa.array(np.diff(starts)), pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64())]
                if any(len(a) != n for a, n in zip(arrays, np.diff(starts), strict=True)):
                    raise ValueError("a frame does not hold as many ids as the index says")
                yield pa.RecordBatch.from_arrays(out + ([pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64()))] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return blobs.select("shard", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of this id: reads the blobs whose range holds it and decompresses their frames alone."""
    dictionary, found = dictionary_of(spark, path), []
    for r in spark.read.schema(BLOB).parquet(f"{path}/blobs").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("shard", "blob_no").select("blob").toLocalIterator():
        ids, _, get = open_blob(bytes(r[0]), dictionary)
        found += [get(i).tolist() for i in np.flatnonzero(ids == doc_id)]
    return found


def scratch(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/gridols-tokens-{uuid.uuid4().hex}"
