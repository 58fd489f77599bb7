"""Operators over occurrence tables that several plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.session import materialized


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their ordinal ``rn``. Spark cuts groups before the exchange."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(first).cast("bigint")).where(F.col("rn") <= n)


def first_wins(frames: Sequence[DataFrame], keys: Sequence[str], *tie: Column) -> DataFrame:
    """The union of frames; of rows of one key, that of the earliest frame stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_seq", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return best_per_key(out, keys, F.col("_seq"), *tie).drop("_seq")


def upsert(base: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``change`` in place of those of equal key."""
    return base.join(change.select(*keys).distinct(), list(keys), "left_anti").unionByName(change)


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key (ties: the smallest), with its count ``n``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return best_per_key(counted, keys, F.desc("n"), F.asc(value))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact percentiles: the row at floor(n * p) + 1 in order. One row per key and p.

    Rows are dealt to ranges of (keys, value, tie). Counts tell the range that holds a wanted
    row, and only such ranges are numbered, so that no key is sorted in one task.
    """
    at, start, total = F.col("_at"), F.col("_start"), F.col("_total")
    ranges = materialized(df.select(*keys, value, tie).repartitionByRange(*keys, value, tie).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (F.floor(total * p) + 1).alias("at")) for p in quantiles)))
    wanted = counts.withColumn("_w", wanted).select(*keys, "_range", "_start", "_n", F.col("_w.p").alias("p"), F.col("_w.at").alias("_at")).where((at > start) & (at <= start + F.col("_n")))
    wanted = wanted.select(*keys, "_range", "p", (at - start).alias("_rn"))
    held = ranges.join(wanted.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
    ranked = held.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value, tie)).cast("bigint"))
    return ranked.join(wanted, [*keys, "_range", "_rn"]).select(*keys, "p", value)


def ordinal(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in a global order, from 1.

    A window without keys would send all rows to one task. Rows are sorted in ranges instead;
    a row's place is that in its range, which its generated id holds, and the number of rows
    in the ranges before, which is one row per range.
    """
    ranges = materialized(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    range_ = F.shiftright("_id", 33)
    starts = ranges.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(starts, range_ == F.col("_range")).withColumn(name, F.col("_start") + place).drop("_id", "_range", "_start")


def first_values(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """keys and ``values``, the first ``n`` distinct values in order. Groups are cut before they meet in a list."""
    top = top_per_key(df.select(*keys, value).distinct(), keys, n, F.asc(value))
    return top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", value))), lambda x: x[value]).alias("values"))


def ranking(df: DataFrame, keys: Sequence[str], video: str, when: str) -> DataFrame:
    """Ordinal ranking: occurrences, distinct videos, earliest occurrence, then the keys.

    The counts are partial before the exchange; only entities are sorted, not occurrences.
    """
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(video).alias("videos"), F.min(when).alias("first_seen"))
    return ordinal(agg, [F.desc("occurrences"), F.desc("videos"), F.asc("first_seen"), *(F.asc(k) for k in keys)])


def connected_components(edges: DataFrame, materialize) -> DataFrame:
    """node and component (its smallest node) for undirected edges (a, b).

    Labels are passed on to neighbours, and to the label's own neighbours, until no label
    changes; ``materialize`` cuts the lineage after each round.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = materialize(new.join(jump, F.col("component") == F.col("_n"), "left").select("node", F.least("component", "_c").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "_old"), "node").where("component <> _old").limit(1).count()
        label = new
        if not moved:
            return label
