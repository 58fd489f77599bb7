"""Operator 6: a quality classifier of naive Bayes features and a support vector machine.

Indicators of n-grams are scaled by their log-count ratio between the classes; a linear
model with hinge loss is fitted to the scaled, length-normalised vectors by dual coordinate
descent, and drawn towards the plain ratios (``BLEND``). A logistic curve fitted to rows
kept out of the fit turns its margins into scores.

N-grams are of three views of a text: its bytes (orders 2 to 4), the shapes of its signs
(letters, capitals and digits as classes, runs up to three), and how much of it repeats
(the share of distinct n-grams and of words that equal the word before, in steps). All are
hashed into ``2 ** BITS`` features. Only texts are looked at.

The fit uses at most ``SAMPLE`` labelled rows per class, those of the lowest hash of their
id; scores and everything else cover all rows and whole texts. A row is learned from only
if the CRC-32 of its id, as text, is no multiple of 5.

Defined results: a null text is empty; an empty text has a score from the constant feature
alone; an id with contradicting labels is not learned from; a row of null id is held out;
with labels of one class or none the score is that share, or 0.5; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from encore.llm.common import free_name, slices, table

BITS = 18
#: Labelled rows of each class that are fitted to, at most.
SAMPLE = {0: 3000, 1: 5000}
#: Features of the sample's rows of each class, at most (four bytes each): a row may have up to 2^BITS.
SAMPLE_FEATURES = 16 << 20
SMOOTHING = 1.0
COST = 10.0
EPOCHS = 12
BLEND = 0.7
#: One in so many rows of the sample is kept for the logistic curve.
KEPT = 4
THRESHOLD = 0.3
#: Texts that are scored at a time, and their bytes (a longer text alone).
ROWS, BYTES = 256, 1 << 20


def shapes() -> np.ndarray:
    """A class for every byte: lower case or non-ASCII, capitals and digits; others themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


SHAPES = shapes()
MULTIPLIER = np.uint32(0x9E3779B1)


def hashed(grams: np.ndarray, view: int) -> np.ndarray:
    """grams: uint32, four signs each."""
    x = (grams ^ np.uint32(view * 0x85EBCA6B & 0xFFFFFFFF)) * MULTIPLIER
    return (x ^ (x >> np.uint32(15))) * MULTIPLIER >> np.uint32(32 - BITS)


def packed(signs: np.ndarray) -> np.ndarray:
    """For every place the four signs up to it, in one number."""
    x = signs.astype(np.uint32)
    out = x.copy()
    for i in (1, 2, 3):
        out[i:] |= x[:-i] << np.uint32(8 * i)
    return out


def features(text: str) -> np.ndarray:
    """The distinct features of a text, as int32 in ascending order. 0 is the constant."""
    found = np.zeros(1 << BITS, bool)
    found[0] = True
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data):
        grams = packed(data)
        for view, mask in ((1, 0xFFFF), (2, 0xFFFFFF), (3, 0xFFFFFFFF)):
            found[hashed(grams & np.uint32(mask), view)] = True
        shape = SHAPES[data]
        if len(shape) > 3:
            same = (shape[3:] == shape[2:-1]) & (shape[2:-1] == shape[1:-2]) & (shape[1:-2] == shape[:-3])
            shape = shape[np.concatenate(([True] * 3, ~same))]
        grams = packed(shape)
        for view, mask in ((4, 0xFFFFFF), (5, 0xFFFFFFFF)):
            found[hashed(grams & np.uint32(mask), view)] = True
        words = text.split()
        repeats = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
        distinct = len(set(words)) / max(1, len(words))
        length = min(9, int(np.log2(len(words) + 1)))
        steps = np.array([*range(int(repeats * 10) + 1), *range(109, 99 + int(distinct * 10), -1), 1000 + int(distinct * 10) + 100 * length], np.uint32)
        found[hashed(steps, 6)] = True
    return np.flatnonzero(found).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(self.scale[x].sum()))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    sums = {c: np.full(1 << BITS, SMOOTHING) for c in (0, 1)}
    for x, c in zip(rows, y, strict=True):
        sums[int(c)][x] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    ratio[0] = 1.0  # the constant
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int) -> np.ndarray:
    """min |w|^2 / 2 + sum of cost * max(0, 1 - y w.x), one dual variable at a time."""
    w, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    square = [float(v @ v) for v in values]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * float(w[x] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[x] += step * y[i] * v
                alpha[i] = new
                largest = max(largest, abs(step) * square[i])
        if largest < 1e-3:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with softened targets."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        ga, gb = (g * margins).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * margins * margins).sum() + 1e-3, (h * margins).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """rows: features; y: 0 or 1; share: of label 1 among all labelled rows."""
    if not len(rows) or y.min() == y.max():
        p = 0.5 if not len(rows) else float(np.clip(y.mean(), 0.01, 0.99))
        return Model(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, float(np.log(p / (1 - p))))
    kept = np.arange(len(rows)) % KEPT == 0
    if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
        kept = np.ones(len(rows), bool)
    used = ~kept if not kept.all() else kept
    ratio = log_count_ratios([rows[i] for i in np.flatnonzero(used)], y[used])
    values = []
    for i in np.flatnonzero(used):
        v = ratio[rows[i]]
        values.append((v / np.sqrt(v @ v)).astype(np.float32))
    n1 = float(y[used].sum())
    cost = COST * np.where(y[used] == 1, share / n1, (1 - share) / (used.sum() - n1)) * used.sum()
    w = dual_coordinate_descent([rows[i] for i in np.flatnonzero(used)], values, np.where(y[used] == 1, 1.0, -1.0), cost, EPOCHS)
    blended = (1 - BLEND) * np.abs(w).mean() + BLEND * w
    model = Model((ratio * blended).astype(np.float32), (ratio * ratio).astype(np.float32), 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(kept)])
    k1 = max(1.0, float(y[kept].sum()))
    weight = np.where(y[kept] == 1, share / k1, (1 - share) / max(1.0, kept.sum() - k1)) * kept.sum()
    model.slope, model.offset = logistic(margins, y[kept], weight)
    return model


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y")
    lowest = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in SAMPLE.items()]
    sample = lowest[0].unionByName(lowest[1]).select(F.col("doc_id").alias("_id"), F.col("y").cast("int"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most sum(SAMPLE) ids: small enough to go to every executor.
    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", ROWS, BYTES)):
            x = pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), x], ["doc_id", "y", "x"])

    share = counts.get(1, 0) / max(1, sum(counts.values()))

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("y", "doc_id", "x")), strict=True))
        # Rows of one class after the other, so that every KEPT-th row has both.
        m = fit([np.frombuffer(x, np.int32) for _, _, x in found], np.array([c for c, _, _ in found], np.int64), share)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (m.weights.tobytes(), m.scale.tobytes(), m.slope, m.offset)], ["weights", "scale", "slope", "shift"])

    # The sample is bounded in rows and features; one task fits it, and only the model comes to the driver.
    extracted = picked.select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, x binary")
    drawn = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = extracted.withColumn("_features", F.sum(F.length("x") / 4).over(drawn)).where(F.col("_features") <= SAMPLE_FEATURES).drop("_features")
    m = bounded.repartition(1).mapInArrow(fit_sample, "weights binary, scale binary, slope double, shift double").first()
    if m is None:  # no sample at all
        return fit([], np.zeros(0, np.int64), share)
    return Model(np.frombuffer(m.weights, np.float32), np.frombuffer(m.scale, np.float32), m.slope, m.shift)


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted", text: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score, predicted)
    names, at = docs.columns, docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (part for whole in batches for part in slices(whole, at, ROWS, BYTES)):
            s = np.array([m.score(features(t or "")) for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, score, predicted])

    return docs.mapInArrow(apply, StructType(docs.schema.fields[:]).add(score, DoubleType()).add(predicted, IntegerType()))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, trained on ``labels``, does not reject.

    All columns stay as they are: the model's two take names that ``docs`` hasn't.
    """
    score, predicted = free_name(docs.columns, "_score"), free_name(docs.columns, "_predicted")
    return scored(docs, train(docs, labels), score, predicted).where(F.col(predicted) == 1).drop(score, predicted)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
