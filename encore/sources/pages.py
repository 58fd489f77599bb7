"""A published folder of pages: written where changed, pruned where gone, verified when read.

Each page is a folder of JSON lines named by its number and the digest of its content; a
manifest lists the pages of a version with their digests and rows. A page whose digest the
folder has already is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGEST_CHARS = 12


def digests(rows: DataFrame, order: str) -> DataFrame:
    """page, n and digest of the pages of ``rows``, a column ``page`` and others; pages are of bounded size."""
    line = F.to_json(F.struct(order, *(c for c in rows.columns if c not in ("page", order))))
    held = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return held.select("page", "n", F.substring(F.sha2(text, 256), 1, DIGEST_CHARS).alias("digest"))


def published(folder: str, rows: DataFrame, order: str, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes a version of the pages; its manifest and what was done: page and written, kept or pruned.

    before: the manifest of the version before, if there is one.
    """
    spark = rows.sparkSession
    now = digests(rows, order)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*")) or [])
    manifest = f"{folder}/manifest-{count:06d}"
    now.write.parquet(manifest)
    now = spark.read.schema(now.schema).parquet(manifest)
    old = now.limit(0) if before is None else before
    new = now.join(old, ["page", "digest"], "left_anti").select("page", "digest")
    rows.join(new, "page").repartition("page").sortWithinPartitions("page", order).write.partitionBy("page", "digest").mode("append").json(f"{folder}/pages")
    gone = old.join(now, ["page", "digest"], "left_anti").select("page", "digest")
    for r in gone.toLocalIterator():  # names of folders to delete
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pages/page={r.page}/digest={r.digest}"), True)
    both = now.select("page", F.col("digest").alias("a")).join(old.select("page", F.col("digest").alias("b")), "page", "full")
    done = both.select("page", F.when(F.col("a").isNull(), "pruned").when(F.col("a") == F.col("b"), "kept").otherwise("written").alias("change"))
    return now, done


def verified(folder: str, manifest: DataFrame, schema: str, order: str) -> DataFrame:
    """The rows of the pages as read back; a page that is not what the manifest says is an error."""
    rows = manifest.sparkSession.read.schema(f"{schema}, page bigint, digest string").json(f"{folder}/pages")
    found = digests(rows.drop("digest"), order).select("page", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    same = manifest.join(found, "page", "full").agg(F.bool_and(F.coalesce((F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), F.lit(False))).alias("ok")).first().ok
    if same is False:
        raise ValueError("a page differs from the manifest")
    return rows.drop("digest")
