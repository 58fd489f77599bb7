"""Operator 5: near-duplicates by DartMinHash signatures and a banded join.

A document is the multiset of its shingles of five words; the similarity of two is the sum
of the lesser over the sum of the greater multiplicities. Darts are thrown into the region
of each weighted shingle (a unit cell per occurrence, times the rank axis in unit strips,
with exponential steps) up to a rank at which all coordinates are expected to be hit; each
dart belongs to one of ``BANDS * ROWS`` coordinates, and the earliest of a coordinate is
kept. Two documents agree in a coordinate with the probability of their similarity. At 0.8
they share no band with probability below 5e-5, and less above.

Links are exact: similarities come from the multisets themselves.

1. Rows of equal text are one document until the end, that of the smallest id.
2. In every bucket of a band, each document is compared to the one of the smallest id and to
   one drawn by hash. First one such pair for each document, then the others that are not
   yet in one class. This makes one class of nearly all of a large group of near copies.
3. Buckets that still hold several classes are compared in full, but for pairs within one
   class, in blocks of ``BLOCK`` rows that are dealt out over all tasks. Only links that
   join classes are kept.
4. After each step classes are the connected components of the classes so far and the new
   links, by large-star and small-star steps. Nothing of this comes to the driver but counts.

Defined results: a null text is an empty one, and empty texts are copies of one another;
a text of fewer than five words has one shingle of all its words, one of no words one of its
signs; an id with several texts joins their classes, which are searched by text; rows of null id
are in no class; an empty table gives no rows; other columns are ignored by ``classes`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.common import free_name, keeping, slices, table, written
from encore.llm.mph import mix
from encore.llm.shingles import shingles

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
BLOCK = 256
#: Texts that are hashed at a time, and their bytes (a longer text alone).
BATCH, BATCH_BYTES = 256, 1 << 20


def cells(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every unit of weight of every text's shingles, sorted by text, and the text."""
    grams, owner = shingles(texts, n)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    at = np.arange(len(grams))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return mix(grams + copy.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 11), owner


def _step(x: np.ndarray) -> np.ndarray:
    """Exponential steps of mean 1 from hashes."""
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def dart_minhash(cell: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: the rank (as the bits of a 32-bit float) of the earliest dart in every coordinate.

    cell: hashes of unit cells; owner: the row of each, ascending.
    """
    out = np.zeros((n, k), np.uint32)
    darts = k * np.log(k) + 2 * k
    weight = np.bincount(owner, minlength=n)
    rows = np.arange(n)[weight > 0]
    while len(rows):
        # Only rows with an empty coordinate go round again, with twice the darts.
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        mine = place[owner]
        use = mine >= 0
        row, base = mine[use], cell[use]
        limit = darts / weight[rows]
        strips = np.ceil(limit).astype(np.int64)
        times = strips[row]
        strip = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, base = np.repeat(row, times), mix(np.repeat(base, times) + strip.astype(np.uint64), 12)
        end, rank = np.minimum(strip + 1.0, limit[row]), strip.astype(np.float64)
        found = []
        wave = 13
        while len(row):
            hit = mix(base, wave)
            rank = rank + _step(hit)
            inside = rank <= end
            row, base, rank, end = row[inside], base[inside], rank[inside], end[inside]
            coordinate = (mix(hit[inside], 1) % np.uint64(k)).astype(np.uint64)
            found.append((row.astype(np.uint64) * np.uint64(k) + coordinate) << np.uint64(32) | rank.astype(np.float32).view(np.uint32).astype(np.uint64))
            wave += 1
        every = np.sort(np.concatenate(found))
        group = every >> np.uint64(32)
        first = np.ones(len(every), bool)
        first[1:] = group[1:] != group[:-1]
        signature = np.zeros(len(rows) * k, np.uint32)
        signature[group[first].astype(np.int64)] = (every[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        signature = signature.reshape(len(rows), k)
        whole = (signature > 0).all(1)
        out[rows[whole]] = signature[whole]
        rows, darts = rows[~whole], darts * 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands: a hash of each band's coordinates."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    keys += np.arange(bands, dtype=np.uint64)
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    for i in range(rows):
        keys = mix(keys + parts[:, :, i], 14)
    return keys.view(np.int64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets as sorted arrays of distinct cells."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, content (a digest of the text) and bands of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", BATCH, BATCH_BYTES):
                texts = b.column("text").to_pylist()
                distinct = list(dict.fromkeys(texts))
                place = {t: i for i, t in enumerate(distinct)}
                cell, owner = cells(distinct)
                keys = band_keys(dart_minhash(cell, owner, len(distinct), bands * rows), bands, rows)
                keys = keys[[place[t] for t in texts]].reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), lists], ["doc_id", "content", "bands"])

    return docs.withColumn("content", F.unhex(F.md5("text"))).select("doc_id", "content", "text").mapInArrow(sign, "doc_id long, content binary, bands array<bigint>")


def cell_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its multiset as sorted 32-bit cells (one in 2^32 of foreign pairs agree)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", BATCH, BATCH_BYTES):
                cell, owner = cells(b.column("text").to_pylist())
                cuts = np.searchsorted(owner, np.arange(1, b.num_rows))
                sets = [np.unique((c >> np.uint64(32)).astype("<u4")).tobytes() for c in np.split(cell, cuts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "cells"])

    return docs.select("doc_id", "text").mapInArrow(gather, "doc_id long, cells binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` that reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("cells").alias("cells_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("cells").alias("cells_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("cells_a"), batch.column("cells_b")
            good = [weighted_similarity(np.frombuffer(x[i].as_buffer(), "<u4"), np.frombuffer(y[i].as_buffer(), "<u4")) >= similarity for i in range(batch.num_rows)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "cells_a", "cells_b").mapInArrow(compare, "a long, b long")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and class (its smallest node) of every node of ``links`` (a, b); rows: a bound of them."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows=rows)
    state = None
    while True:
        # Large star: every larger neighbour of a node gets the smallest of its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, rows=rows)
        # Small star: a node and its smaller neighbours get the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        joined = large.join(least, F.col("u") == F.col("_u"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, rows=rows)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
        state = now


def across(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one class."""

    def of(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(f"_{name}"), F.col("class").alias(f"class_{name}"))

    out = pairs.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    return out.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")


class _Block:
    """The rows of one block of a bucket, against which others are compared one at a time."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.ids: list[int] = []
        self.classes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.joined: dict[int, int] = {}
        self.flat = None

    def top(self, c: int) -> int:
        while (up := self.joined.setdefault(c, c)) != c:
            c = self.joined[c] = self.joined[up]
        return c

    def add(self, id_: int, class_: int, cells_: np.ndarray) -> None:
        self.ids.append(id_), self.classes.append(class_), self.sets.append(cells_)

    def links(self, id_: int, class_: int, cells_: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of a row to rows of the block; none within a class, one for each two classes."""
        if not self.ids or not len(cells_):
            return
        if self.flat is None:
            self.flat = np.concatenate(self.sets)
            self.sizes = np.array([len(x) for x in self.sets])
            self.starts = np.cumsum(self.sizes) - self.sizes
        place = np.searchsorted(cells_, self.flat)
        place[place == len(cells_)] = 0
        common = np.add.reduceat(cells_[place] == self.flat, self.starts, dtype=np.int64)
        near = common >= self.similarity * (self.sizes + len(cells_) - common)
        for i in np.flatnonzero(near).tolist():
            if (x := self.top(self.classes[i])) != (y := self.top(class_)):
                self.joined[x] = y
                yield id_, self.ids[i]


def block_links(buckets: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between classes within buckets (bucket, doc_id) that hold several.

    The rows of a bucket are dealt to blocks. Of two rows of different classes one at least
    is not of the bucket's largest class: such rows visit all blocks of their bucket, the
    others none. A block is held in memory, its visitors pass by.
    """
    member = buckets.join(classes, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("class", "doc_id").alias("class"))
    by_class = member.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_class.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("_major"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_classes")).where("_classes > 1")
    mixed = mixed.select(F.col("bucket").alias("_bucket"), "_major", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    member = member.join(mixed, F.col("bucket") == F.col("_bucket"))
    at = lambda block, visits: F.struct(block.alias("block"), F.lit(visits).alias("visits"))
    home = F.array(at(F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"), False))
    places = F.when(F.col("class") == F.col("_major"), home).otherwise(F.concat(home, F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: at(i, True))))
    dealt = member.select("bucket", "doc_id", "class", F.explode(places).alias("p")).select("bucket", "doc_id", "class", "p.block", "p.visits")
    dealt = dealt.join(sets, "doc_id").select("bucket", "block", "visits", "doc_id", "class", "cells")
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, _Block(similarity)
        for b in batches:
            out: list[tuple[int, int]] = []
            rows = zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "visits", "doc_id", "class")), b.column("cells"), strict=True)
            for bucket, number, visits, id_, class_, cells_ in rows:
                if (bucket, number) != current:
                    current, block = (bucket, number), _Block(similarity)
                own = np.frombuffer(cells_.as_buffer(), "<u4")
                if visits:
                    out += block.links(id_, class_, own)
                else:
                    block.add(id_, class_, own)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _several_texts(signs: DataFrame) -> bool:
    """Whether an id has more than one text."""
    h = F.xxhash64("content")
    return bool(signs.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").limit(1).count())


def _text_classes(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id, content, node and class of every text of every id; the class is its smallest node.

    Nodes are numbers of (id, text) in the order of ids.
    """
    texts = docs.where("doc_id IS NOT NULL").withColumn("content", F.unhex(F.md5("text")))
    order = ["doc_id", "content"]
    nodes = written(texts.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    one = written(texts.join(nodes, order).select(F.col("node").alias("doc_id"), "text"))
    found = _classes(one, written(signed(one, bands, rows), "none"), similarity).distinct()
    return written(nodes.join(found.select(F.col("doc_id").alias("_node"), F.col("class_id").alias("class")), F.col("node") == F.col("_node")).select(*order, "node", "class"))


def _id_classes(of_texts: DataFrame) -> DataFrame:
    """node and class of ids that share a class with another; an id joins the classes of its texts."""
    first = of_texts.where("node = class").select(F.col("class").alias("_class"), F.col("doc_id").alias("b"))
    links = of_texts.join(first, F.col("class") == F.col("_class")).select(F.col("doc_id").alias("a"), "b")
    return components(links)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of every row of ``docs``; class_id is the smallest id of the class."""
    docs = _texts(docs, key, text)
    unnamed = docs.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    signs = written(signed(docs.where("doc_id IS NOT NULL"), bands, rows), "none")
    if not _several_texts(signs):
        return _classes(docs, signs, similarity).unionByName(unnamed)
    known = _id_classes(_text_classes(docs, similarity, bands, rows)).select(F.col("node").alias("_id"), "class")
    return docs.select("doc_id").join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def _classes(docs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """doc_id and class_id of every row of ``signs``, where each id has one text.

    What is used again stays on the executors' disks until the classes are written; a lost
    part is made again from ``signs``, which is in the shared folder, and from ``docs``.
    Ids that texts and signatures are joined to grow with the documents. Those joins are
    merge joins at every size: the plan of a small input is that of a large one.
    """
    with keeping() as keep:
        # 1. One row for each text, under its smallest id.
        texts = keep(signs.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
        # 2. Buckets.
        buckets = texts.select("doc_id", F.explode("bands").alias("bucket"))
        any_ = F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id")))
        shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), any_.alias("_any")).where("rep < _last").select(F.col("bucket").alias("_bucket"), "rep", F.col("_any.id").alias("other"))
        buckets = keep(buckets.join(shared, F.col("bucket") == F.col("_bucket")).select("bucket", "doc_id", "rep", "other"))
        involved = buckets.select(F.col("doc_id").alias("_id")).distinct()
        mine = docs.join(involved.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
        sets = keep(cell_sets(mine.dropDuplicates(["doc_id"])))
        pair = F.explode(F.array("rep", "other")).alias("b")
        candidates = keep(buckets.select(F.col("doc_id").alias("a"), pair).where("a <> b").distinct())
        size = candidates.count()
        nearest = candidates.where("b < a").groupBy("a").agg(F.min("b").alias("b"))
        known = components(verified(nearest, sets, similarity), size)
        others = candidates.join(nearest, ["a", "b"], "left_anti")
        so_far = known.select(F.col("node").alias("a"), F.col("class").alias("b"))
        known = components(so_far.unionByName(verified(across(others, known), sets, similarity)), size)
        # 3. Buckets of several classes.
        so_far = known.select(F.col("node").alias("a"), F.col("class").alias("b"))
        known = components(so_far.unionByName(block_links(buckets.select("bucket", "doc_id"), known, sets, similarity)), size)
        # 4. Rows of equal text are in the class of that text.
        of_text = texts.select("content", "doc_id").join(known, F.col("doc_id") == F.col("node"), "left").select(F.col("content").alias("_content"), F.coalesce("class", "doc_id").alias("class_id"))
        return written(signs.select("doc_id", "content").join(of_text.hint("merge"), F.col("content") == F.col("_content")).select("doc_id", "class_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; of repeated rows, one.

    Where an id has several texts, the classes are those of texts, and each keeps one text of
    its smallest id. Rows of null id are all kept. Added columns take names that ``docs`` hasn't.
    """
    id_, content_ = free_name(docs.columns, "_id"), free_name(docs.columns, "_content")
    kept_ = free_name([*docs.columns, content_], "_kept")
    found = _texts(docs, key, text)
    signs = written(signed(found.where("doc_id IS NOT NULL"), bands, rows), "none")
    if _several_texts(signs):
        kinds = _text_classes(found, similarity, bands, rows).where("node = class").select(F.col("doc_id").alias(id_), F.col("content").alias(kept_))
        content = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        rows_ = docs.where(F.col(key).isNotNull()).withColumn(content_, content)
        once = rows_.join(kinds, (F.col(key) == F.col(id_)) & (F.col(content_) == F.col(kept_)), "left_semi").dropDuplicates([key, content_]).drop(content_)
        return docs.where(F.col(key).isNull()).unionByName(once)
    found = _classes(found, signs, similarity)
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(id_)).distinct()
    kept = docs.join(gone.hint("merge"), F.col(key) == F.col(id_), "left_anti")
    repeated = found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_))
    if not repeated.limit(1).count():
        return kept
    repeated = written(repeated)
    once = kept.join(repeated, F.col(key) == F.col(id_), "left_semi").dropDuplicates([key])
    return kept.join(repeated, F.col(key) == F.col(id_), "left_anti").unionByName(once)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
