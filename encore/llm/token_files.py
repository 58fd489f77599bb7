"""Operator 2: token ids in binary shards with a minimal perfect hash index.

A shard is two files. ``NAME.ids`` holds the ids of its documents one after another, raw
and little-endian (16 bits if the vocabulary allows, else 32). ``NAME.idx`` holds the keys
in the order of the shard, the start of each document, a minimal perfect hash of the keys,
and per slot a fingerprint of 32 bits and the place of its document. ``Shard.ids`` finds a
document with one hash, one fingerprint and one slice, whatever the size of the shard.

Documents are in ascending key order (null keys first, rows of one key by a hash of their
text) within and over all shards; each task writes the shards of one range of keys, and
closes a shard when it has ``SHARD_TOKENS`` ids or ``SHARD_DOCS`` documents.

Words are encoded by the tokenizers library, once each while a worker keeps them: byte-level
pretokens never span a single space between two other characters, so the ids of a text are
those of its words, each with the space before it. Words of Latin letters and signs are cut
into their pretokens and given to the library's BPE model, other words to its tokenizer.
Texts in which spaces stand beside white space, and texts with a special string, are
encoded as a whole.

Defined results: a null text is empty and gives the end id alone; rows of equal key are
documents of their own, told apart by an ordinal within their shard; a null key is a key;
an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.llm.common import new_file, old_file, shared_dir, table, written
from encore.llm.mph import PerfectHash, mix

END_ID = 0
SHARD_TOKENS = 8 << 20
SHARD_DOCS = 1 << 16
ROWS = 256
CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
MAGIC = b"ENCTOK01"
#: Signs that form one pretoken with one another, and none with letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Below this character the library and Python agree on what a letter is.
LETTERS_END = "\u0250"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: visible Latin-1 signs stand for
    themselves, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words, as bytes, each with ``lead`` before it; None: not a word of its own."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        ids = self.encoder.simple(word, self.lead)
        if ids is None:
            ids = self.encoder.whole([self.lead + word])[0]
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.type = f"<u{self.width}"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.space = self.letters[ord(" ")]
        #: Ids of pretokens: letters with or without the space before them, or signs.
        self.pretokens: dict[str, bytes] = {}
        self.words, self.heads = _Words(self, " "), _Words(self, "")

    def bytes_of(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.bytes_of(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pretoken(self, text: str) -> bytes:
        ids = self.pretokens.get(text)
        if ids is None:
            if len(self.pretokens) > CACHE_ENTRIES:
                self.pretokens.clear()
            mapped = text.encode().decode("latin-1").translate(self.letters) if not text.isascii() or "\n" in text else text.replace(" ", self.space)
            ids = self.pretokens[text] = self.bytes_of([t.id for t in self.model.tokenize(mapped)])
        return ids

    def simple(self, word: str, lead: str) -> bytes | None:
        """Ids of a word of Latin letters, signs after them, and single line ends within."""
        out = []
        for line in word.split("\n"):
            letters = line.rstrip(SIGNS)
            if not letters.isalpha() or not letters.isascii() and max(letters) >= LETTERS_END:
                return None
            ids = self.pretoken(lead + letters)
            out.append(ids if len(letters) == len(line) else ids + self.pretoken(line[len(letters) :]))
            lead = ""
        return out[0] if len(out) == 1 else self.pretoken("\n").join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        word, head = self.words.__getitem__, self.heads.__getitem__
        for t in texts:
            ids = None
            if not any(s in t for s in self.special):
                words = iter(t.split(" "))
                first = head(next(words))
                if first is not None:
                    try:
                        ids = first + b"".join(map(word, words))
                    except TypeError:  # white space beside a space
                        pass
            out.append(ids)
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self.whole([texts[i] for i in left]), strict=True):
            out[i] = x
        return out


@lru_cache(2)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def hashed(keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key or null, ordinal)."""
    with np.errstate(over="ignore"):
        return mix(mix(keys.astype(np.int64).view(np.uint64) + nulls.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), 101) + ordinals.astype(np.uint64), 102)


def ordinals_of(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How many rows of the same key stand before each, keys in order."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 103) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: list[int | None], lengths: list[int], width: int) -> bytes:
    nulls = np.array([k is None for k in keys], np.uint8)
    values = np.array([0 if k is None else k for k in keys], "<i8")
    hashes = hashed(values, nulls, ordinals_of(values, nulls))
    perfect = PerfectHash.build(hashes)
    slots = perfect.slots(hashes)
    prints, places = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slots], places[slots] = fingerprints(hashes), np.arange(len(keys))
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    return b"".join((MAGIC, np.array([len(keys), width], "<u8").tobytes(), values.tobytes(), starts.tobytes(), prints.tobytes(), places.tobytes(), nulls.tobytes(), bytes(-len(keys) % 8), perfect.dump()))


class Shard:
    """A shard as read: its index, and the ids of any key by one lookup."""

    def __init__(self, index: bytes, payload: bytes):
        if index[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        n, width = map(int, np.frombuffer(index, "<u8", 2, 8))
        at = 24
        self.keys = np.frombuffer(index, "<i8", n, at)
        self.starts = np.frombuffer(index, "<u8", n + 1, at := at + 8 * n).astype(np.int64)
        self.prints = np.frombuffer(index, "<u4", n, at := at + 8 * (n + 1))
        self.places = np.frombuffer(index, "<u4", n, at := at + 4 * n)
        self.nulls = np.frombuffer(index, np.uint8, n, at := at + 4 * n)
        self.hash, _ = PerfectHash.load(memoryview(index)[at + n + -n % 8 :])
        self.payload = np.frombuffer(payload, f"<u{width}")
        if len(self.payload) != self.starts[-1]:
            raise ValueError("the payload's length differs from the index's")

    def places_of(self, keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """The place of each key in the shard; -1: not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        hashes = hashed(keys, nulls, ordinals)
        slots = self.hash.slots(hashes)
        good = (slots >= 0) & (self.prints[slots] == fingerprints(hashes))
        return np.where(good, self.places[slots].astype(np.int64), -1)

    def ids(self, key: int | None, ordinal: int = 0) -> np.ndarray | None:
        place = int(self.places_of(np.array([key or 0]), np.array([key is None]), np.array([ordinal]))[0])
        # The fingerprint rejects all but one in 2^32 foreign keys, the key itself the rest.
        if place < 0 or self.nulls[place] != (key is None) or self.keys[place] != (key or 0):
            return None
        return self.payload[self.starts[place] : self.starts[place + 1]]


def write_shards(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the ids of all rows; returns path, part, seq, docs, tokens of each shard."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, enc = TaskContext.get(), encoder(tokenizer_file)
        part, name = context.partitionId(), f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        end = np.array([END_ID], enc.type).tobytes()
        keys: list = []
        payloads: list[bytes] = []
        done: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal held
            path = f"{name}-{len(done):05d}"
            with new_file(f"{path}.ids") as out:
                for p in payloads:
                    out.write(p)
            with new_file(f"{path}.idx") as out:
                out.write(index_bytes(keys, [len(p) // enc.width for p in payloads], enc.width))
            done.append((path, part, len(done), len(keys), held // enc.width))
            keys.clear(), payloads.clear()
            held = 0

        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                for k, ids in zip(b.column("key").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    keys.append(k)
                    payloads.append(ids + end)
                    held += len(ids) + enc.width
                    if held >= SHARD_TOKENS * enc.width or len(keys) >= SHARD_DOCS:
                        close()
        if keys:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "part", "seq", "docs", "tokens"])

    return written(rows.mapInArrow(write, "path string, part long, seq long, docs long, tokens long"))


def with_starts(shards: DataFrame) -> DataFrame:
    """``shards`` with the number of ids before each: within parts, then over parts."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_tokens").over(over_parts), F.lit(0)).alias("_before"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    joined = shards.withColumn("_within", F.coalesce(F.sum("tokens").over(in_part), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    return joined.withColumn("start", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def read_shards(shards: DataFrame, parallel: int | None = None) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, each found through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                with old_file(f"{path}.idx") as f, old_file(f"{path}.ids") as g:
                    shard = Shard(f.read(), g.read())
                places = shard.places_of(shard.keys, shard.nulls, ordinals_of(shard.keys, shard.nulls))
                if (places != np.arange(len(places))).any():
                    raise ValueError(f"the index of {path} does not lead to its documents")
                begins, ends = shard.starts[places], shard.starts[places + 1]
                crcs = [zlib.crc32(shard.payload[s:e].astype("<u4")) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                keys = pa.array(shard.keys, mask=shard.nulls.astype(bool))
                for i in range(0, len(crcs), 10_000):
                    j = i + 10_000
                    yield pa.RecordBatch.from_arrays([keys[i:j], pa.array(begins[i:j] + start), pa.array((ends - begins)[i:j]), pa.array(crcs[i:j], pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    parallel = parallel or int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = with_starts(shards).select("path", "start").repartition(parallel)
    return spread.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_file)).withColumnRenamed("key", "doc_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
