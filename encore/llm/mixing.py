"""Operator 7: mixing sources to target weights, in DataFrame operations only.

Each source gets a target size by water-filling: the budget (a share of all sizes) is
divided by weight, no source gets more than ``max_repeat`` times its own size, and what
is over goes to the others by weight until none is above its limit. The repetition rate
of a source is target / size; a document is taken floor(rate) times, plus once more if a
hash of its id and the seed, as a number in [0, 1), is below the fraction of the rate.

Defined results: null or empty text has size 0 and is counted, but takes no words; a null
source is a source of its own, ordered last; a source of size 0 has target 0 and rate 0;
equal ids draw the same number (repeated rows are taken alike); a null id draws as the
word ``null``; an empty table gives no rows; other columns are carried along, but
``mixed`` replaces those that bear the name of one it adds; ``emitted`` keeps all as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.llm.common import free_name, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
#: Keys that the documents of each source are dealt over where Spark does not broadcast the targets.
BUCKETS = 64
#: The columns that ``mixed`` adds.
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, target.

    Every task sums what it has read by source before the exchange, so that a source with
    a large share of all rows is one row per task there. The windows go over sources only.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(max_repeat))
    # A source is full at level limit / weight. In that order, the level reached when all
    # before a source are full tells whether it is full, too.
    order = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(after))
    full = F.col("limit") <= F.col("level") * F.col("weight")
    # Levels fall from the first open source on: it alone has all full ones before it.
    open_level = F.max(F.when(~full, F.col("level"))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", F.when(full, F.col("limit")).otherwise(open_level * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken of each row."""
    docs = docs.drop(*(c for c in ADDED if c not in (key, text, source)))
    of, salt, bucket = (free_name([*docs.columns, *ADDED], c) for c in ("_source", "_salt", "_bucket"))
    sized = docs.withColumn("size", size_of(F.col(text)))
    goal = written(targets(sized.select(F.col(source).alias("source"), "size"), **options).withColumnRenamed("source", of))
    # Spark broadcasts the targets by their size as a table; beyond that, the salt deals a hot source out.
    spread = goal.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    dealt = sized.withColumn(bucket, F.pmod(F.xxhash64(key, text), F.lit(BUCKETS)).cast("int"))
    joined = dealt.join(spread, F.col(source).eqNullSafe(F.col(of)) & (F.col(bucket) == F.col(salt))).drop(bucket, salt, of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    extra = (draw(F.col(key), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).withColumn("taken", F.col("size") * F.col("copies"))


def emitted(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as many times as it is taken.

    Rows travel as a struct of their own, so that no column of theirs meets an added one.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    out = mixed(held, "key", "text", "source", **options).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim
  FROM per_source
), levels AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - COALESCE(SUM(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), goal AS (
  SELECT source, source_size,
    CASE WHEN lim <= level * weight THEN lim ELSE (MAX(CASE WHEN lim > level * weight THEN level END) OVER ()) * weight END AS target
  FROM levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), taken AS (
  SELECT *, (FLOOR(rate) + CASE WHEN ('0x' || md5('{SEED}:' || COALESCE(doc_id::VARCHAR, 'null'))[1:12])::BIGINT::DOUBLE / 281474976710656.0::DOUBLE < rate - FLOOR(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
