"""Structured Streaming jobs, run as bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from encore.session import new_folder


def feed(rows: DataFrame, files: int) -> str:
    """The rows as a folder of files, which a stream takes one after the other."""
    folder = new_folder(rows.sparkSession)
    rows.repartition(files).write.parquet(folder)
    return folder


def source(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1) -> DataFrame:
    """A stream over the files of a folder, ``max_files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs all that is available into a table of the shared folder; offsets and state are there, too."""
    spark = stream.sparkSession
    base = new_folder(spark)
    if mode == "append":
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def daily_counts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Counts by UTC day and kind; late rows update their day."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet").select("ts", "event_type")
    events = source(spark, feed(rows, 3), rows.schema).withColumn("at", F.col("ts").cast("timestamp"))
    counts = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run(counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "complete")


def deduplicated(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The first event of each id within the watermark, of a feed that sends every tenth again."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet").select("event_id", "event_type", "ts")
    rows = rows.unionByName(rows.where("event_id % 10 = 0"))
    events = source(spark, feed(rows, 3), rows.schema).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "60 days")
    return run(events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type", F.unix_micros("at").alias("us")))
