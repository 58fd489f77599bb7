"""Bindings of the performance-log model to the test tables, shared by all plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.plans.registry import table

NOW = "2024-01-31 00:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as occurrences: video, song, artist, seconds, time and scope flags."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video"), F.col("l_partkey").alias("song"), F.col("l_suppkey").alias("artist"), F.col("l_linenumber").cast("bigint").alias("position"),
        F.col("l_shipdate").alias("played"), (F.col("l_returnflag") == "R").alias("niche"), (F.col("l_linestatus") == "F").alias("unknown"), F.col("l_quantity").cast("bigint").alias("seconds"),
    )


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with the texts that a search reads: title, artist, channel and video."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist_name"))
    video = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("video_title"))
    channel = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("channel"))
    o = occurrences(spark, d).join(part, F.col("song") == F.col("p_partkey"), "left").join(video, F.col("video") == F.col("o_orderkey"), "left")
    return o.join(channel, F.col("o_custkey") == F.col("c_custkey"), "left").drop("p_partkey", "o_orderkey", "o_custkey", "c_custkey")


def count() -> F.Column:
    return F.count(F.lit(1))


#: The same binding for oracles.
OCC = "(SELECT l_orderkey AS video, l_partkey AS song, l_suppkey AS artist, l_linenumber::BIGINT AS position, l_shipdate AS played, l_returnflag = 'R' AS niche, l_linestatus = 'F' AS unknown, l_quantity::BIGINT AS seconds FROM lineitem)"

SEARCHABLE = f"(SELECT o.*, p_name AS title, p_brand AS artist_name, c_name AS channel, o_orderpriority AS video_title FROM {OCC} o LEFT JOIN part ON song = p_partkey LEFT JOIN orders ON video = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"
