"""Operator 4: token counts by byte-pair merging with a heap and a linked list.

The pieces and scores of a sentencepiece BPE model are the merge table: of all adjacent
pairs whose concatenation is a piece, the one of the lowest rank (the highest score, then
the leftmost) is merged, until none is left. The count of tokens is the number of initial
symbols less the number of merges; no ids are made. A symbol that is no piece counts as
many tokens as it has UTF-8 bytes (byte fallback).

A merge can join two neighbouring characters only if they are neighbours in some piece.
Texts are cut where they are not (before every space in particular), and counts of short
cuts are kept in a bounded cache per Python worker; a long stretch without a cut is merged
as a whole, in n log n.

Defined results: a null text is empty and has 0 bytes and 0 tokens; repeated rows give
repeated rows; a null id stays null; an empty table gives no rows; columns other than the
key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.common import table

SPACE = "▁"
#: Entries of a worker's caches, and the longest text that they keep.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
ROWS = 256
LIMIT = 4096


def merges_of(ranks: dict[str, float], text: str) -> int:
    """How many merges ``text``, a list of characters at first, goes through."""
    n = len(text)
    size = [1] * n
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(text[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, left, length = heappop(heap)
        right = after[left] if size[left] else -1
        if right < 0 or size[left] + size[right] != length:
            continue  # one of the two has gone into another merge
        merges += 1
        size[left], size[right] = length, 0
        follower = after[left] = after[right]
        if follower >= 0:
            before[follower] = left
            end = follower + size[follower]
            if (rank := ranks.get(text[left:end])) is not None:
                heappush(heap, (rank, left, end - left))
        leader = before[left]
        if leader >= 0 and (rank := ranks.get(text[leader : left + length])) is not None:
            heappush(heap, (rank, leader, left + length - leader))
    return merges


class _Parts(dict):
    """Counts of stretches between cuts."""

    def __init__(self, ranks: dict[str, float], chars: set[str]):
        self.ranks, self.chars = ranks, chars

    def __missing__(self, part: str) -> int:
        symbols = sum(1 if c in self.chars else len(c.encode("utf-8", "surrogatepass")) for c in part)
        n = symbols - merges_of(self.ranks, part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = n
        return n


class _Words(dict):
    """Counts of what stands between single spaces, with the space before it.

    NaN where that is no stretch between cuts: the text then has to be counted in another way.
    """

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, word: str) -> float:
        if not word or SPACE in word:
            return float("nan")
        n = self.counter.cut_and_count(SPACE + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        self.adjacent = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Whether a space never follows another character within a piece.
        self.spaces_lead = not any(p[1] == SPACE != p[0] for p in self.adjacent)
        self.parts = _Parts(pieces, {p for p in pieces if len(p) == 1})
        self.words = _Words(self)

    def cut_and_count(self, text: str) -> int:
        total = start = 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.adjacent:
                total += self.parts[text[start:i]]
                start = i
        return total + self.parts[text[start:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.spaces_lead:
            n = sum(map(self.words.__getitem__, text.split(" ")))
            if n == n:
                return n
        return self.cut_and_count(SPACE + text.replace(" ", SPACE))


@lru_cache(2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def count_tokens(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each row."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(model_file).count
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                texts = b.column("text")
                n = pa.array([count_one(t) for t in texts.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("key"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    counted = rows.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
