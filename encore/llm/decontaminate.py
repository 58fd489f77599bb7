"""Operator 1: benchmark decontamination by greedy string tiling.

Documents and benchmark items share a seed if they share ``MIN_MATCH`` consecutive words.
For each such pair the longest common stretches of unmarked words are marked, again and
again; they are found by Karp-Rabin, whose rolling hashes of any length come from one row of
prefix sums, at the greatest length that still has a match (found by halving). A document
holds an item if the marked stretches, in whatever order they stand, cover at least
``COVERAGE`` of the item's words. Pairs whose shared seeds together can't cover that much are
not tiled.

The benchmark is a stated query set. Its words go to the shared folder as files of
hashes, each for about ``BLOCK_CHARS`` characters; tasks read them one at a time and hold the
index of one. So neither the driver nor a broadcast holds the benchmark, and a task's memory
does not grow with it. Documents are read once and not shuffled.

Defined results: null and empty texts and items match nothing; an item of fewer than
``MIN_MATCH`` words has itself as its seed; items of equal text are reported each; repeated
rows of a document give repeated rows; a null id stays null; empty tables give no rows;
words that repeat in an item or a text, however often, cost no more than others; texts
of any length are taken whole; other columns are ignored by ``matches`` and kept by
``cleaned``, whatever their names.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.common import new_file, old_file, shared_dir, slices, table, written
from encore.llm.shingles import BASE, INVERSE, combined, powers, within, words

MIN_MATCH = 5
COVERAGE = 0.5
#: Characters of benchmark items in one file; a longer item is alone in its file.
BLOCK_CHARS = 8 << 20
#: Documents, and their bytes, that are hashed at a time (a longer document alone).
ROWS, BYTES = 256, 1 << 20
FILTER_BITS = 20


class Rolling:
    """Karp-Rabin hashes of the free stretches of a row of words."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.free = np.ones(len(values), bool)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64)))
        self.back = powers(INVERSE, len(values) + 1)

    def stretches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all free stretches of ``length`` words, ascending, and their hashes."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[length:] == taken[:-length])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.back[at]

    def open(self, at: int, length: int) -> bool:
        """Whether a stretch that was free before others of its length were marked still is."""
        return bool(self.free[at] and self.free[at + length - 1])


def meets(text: Rolling, item: Rolling, length: int) -> bool:
    return bool(np.isin(item.stretches(length)[1], text.stretches(length)[1]).any())


def mark(text: Rolling, item: Rolling, length: int) -> Iterator[tuple[int, int, int]]:
    """Marks all matches of exactly ``length`` words, by place in the item, then in the text."""
    in_item, asked = item.stretches(length)
    in_text, held = text.stretches(length)
    order = np.argsort(held, kind="stable")
    held, in_text = held[order], in_text[order].tolist()
    first, last = np.searchsorted(held, asked, "left").tolist(), np.searchsorted(held, asked, "right").tolist()
    # Marked places stay marked, so each group of equal hashes is gone through once.
    reached: dict[int, int] = {}
    for j, a, b in zip(in_item.tolist(), first, last, strict=True):
        if a == b or not item.open(j, length):
            continue
        k = reached.get(a, a)
        while k < b:
            i = in_text[k]
            k += 1
            if text.open(i, length) and np.array_equal(text.values[i : i + length], item.values[j : j + length]):
                text.free[i : i + length] = item.free[j : j + length] = False
                yield length, i, j
                break
        reached[a] = k


def tiles(text: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes: (length, place in text, place in item)."""
    min_match, most = min(min_match, len(item)), min(len(text), len(item))
    out: list[tuple[int, int, int]] = []
    if min_match < 1:
        return out
    a, b = Rolling(text), Rolling(item)
    while most >= min_match and meets(a, b, min_match):
        low = min_match
        while low < most:
            middle = (low + most + 1) // 2
            if meets(a, b, middle):
                low = middle
            else:
                most = middle - 1
        out += mark(a, b, low)
        most = low - 1
    return out


class Seeds:
    """Benchmark items as word hashes, and an index of their seeds."""

    def __init__(self, ids: list[int | None], hashes: np.ndarray, offsets: np.ndarray, min_match: int):
        self.ids = ids
        self.items = [hashes[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
        self.sizes = np.diff(offsets)
        self.lengths = np.minimum(self.sizes, min_match)
        #: Seeds of each item by place, and where they begin.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: By length: sorted seeds, each once for an item, that item, and a filter over their low bits.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(self.lengths[self.lengths > 0].tolist())):
            places, owner = within(offsets, n)
            mine = self.lengths[owner] == n
            grams, owner = combined(hashes, n)[places[mine]], owner[mine]
            self.grams[n] = grams, np.searchsorted(owner, np.arange(len(ids) + 1))
            order = np.lexsort((owner, grams))
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            low = np.zeros(1 << FILTER_BITS, bool)
            low[grams & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.by_length[n] = grams[new], owner[new].astype(np.int32), low

    def matches(self, texts: list[str], coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """text, item, tiles, covered words and words of the item, of pairs that reach the coverage."""
        hashes, offsets = words(texts)
        for n, (seeds, owner, low) in self.by_length.items():
            places, text = within(offsets, n)
            grams = combined(hashes, n)[places]
            maybe = np.flatnonzero(low[grams & np.uint64((1 << FILTER_BITS) - 1)])
            at = np.minimum(np.searchsorted(seeds, grams[maybe]), len(seeds) - 1)
            maybe = maybe[seeds[at] == grams[maybe]]
            cuts = np.flatnonzero(np.diff(text[maybe])) + 1
            for part in np.split(maybe, cuts) if len(maybe) else ():
                i = int(text[part[0]])
                own = hashes[offsets[i] : offsets[i + 1]]
                yield from self._tiled(i, own, grams[part], places[part] - offsets[i], n, seeds, owner, coverage)

    def _tiled(self, i: int, own: np.ndarray, grams: np.ndarray, at: np.ndarray, n: int, seeds: np.ndarray, owner: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """Pairs of one text, whose places ``at`` hold seeds of ``n`` words."""
        found = np.unique(grams)
        first, last = np.searchsorted(seeds, found, "left"), np.searchsorted(seeds, found, "right")
        counts = last - first
        which = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        every, starts = self.grams[n]
        for j in np.unique(owner[which]).tolist():
            item, mine = self.items[j], every[starts[j] : starts[j + 1]]
            shared = covered(np.flatnonzero(np.isin(mine, found)), n, len(item))
            if shared.sum() < coverage * len(item):
                continue
            # Every match lies within words of seeds: all others are left out, with a gap.
            kept = np.flatnonzero(covered(at[np.isin(grams, mine)], n, len(own)))
            gaps = np.flatnonzero(np.diff(kept) > 1) + 1
            tiled = tiles(np.insert(own[kept], gaps, np.uint64(0)), item, n)
            size = sum(x for x, _, _ in tiled)
            if size >= coverage * len(item):
                yield i, j, len(tiled), size, len(item)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in stretches of ``n`` from ``starts`` on."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def blocks(benchmark: DataFrame, item: str, text: str, chars: int) -> list[str]:
    """Writes the items' word hashes to files of about ``chars`` characters each; their paths."""
    folder = shared_dir(benchmark.sparkSession)
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/block-{context.partitionId():06d}-{context.taskAttemptId()}"
        for k, b in enumerate(part for whole in batches for part in slices(whole, "text", whole.num_rows, chars)):
            hashes, offsets = words(b.column("text").to_pylist())
            ids = b.column("item")
            held = io.BytesIO()
            np.savez(held, ids=ids.fill_null(0).to_numpy(), known=ids.is_valid().to_numpy(zero_copy_only=False), hashes=hashes, offsets=offsets)
            with new_file(f"{name}-{k:05d}.npz") as out:
                out.write(held.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{k:05d}.npz"])], ["path"])

    named = written(items.repartition(max(1, -(-total // chars))).mapInArrow(write, "path string"), rows=1)
    return sorted(r.path for r in named.toLocalIterator())  # one path for each file, not for each item


@functools.lru_cache(maxsize=1)
def seeds_of(path: str, min_match: int) -> Seeds:
    with old_file(path) as f:
        a = np.load(io.BytesIO(f.read()))
        ids = [i if known else None for i, known in zip(a["ids"].tolist(), a["known"].tolist(), strict=True)]
        return Seeds(ids, a["hashes"], a["offsets"], min_match)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, item_words, coverage of each pair at or above the coverage."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    paths = blocks(benchmark, item, item_text, block_chars)
    names = ["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for path in paths:
                seeds = seeds_of(path, min_match)
                for b in slices(whole, "text", ROWS, BYTES):
                    ids = b.column("doc_id").to_pylist()
                    found = [(ids[i], seeds.ids[j], n, c, m, c / m) for i, j, n, c, m in seeds.matches(b.column("text").to_pylist(), coverage)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return rows.mapInArrow(find, "doc_id long, item_id long, n_tiles int, covered int, item_words int, coverage double")


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass."""
    at = docs.columns.index(text)
    paths = blocks(benchmark, item, item_text, block_chars)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for path in paths:
                seeds, clean = seeds_of(path, min_match), []
                for b in slices(whole, at, ROWS, BYTES):
                    mine = np.ones(b.num_rows, bool)
                    mine[[i for i, *_ in seeds.matches([t or "" for t in b.column(at).to_pylist()], coverage)]] = False
                    clean.append(mine)
                if clean:
                    whole = whole.filter(pa.array(np.concatenate(clean)))
            yield whole

    return docs.mapInArrow(drop, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
