"""Revisions of a table: written as drafts, made ready with a digest, activated one at a time.

A revision is a Parquet table beside a manifest that names its parent and the digest of its
rows; it holds only what differs from the parent, and tombstones. Activations are numbered
files that are created only if they don't exist yet, so of two that expect the same state one
fails. All files go through Hadoop's file systems; a store can be any shared folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.hadoop.io.IOUtils
        self._exists = jvm.org.apache.hadoop.fs.FileAlreadyExistsException

    def _put(self, name: str, value: dict) -> None:
        """A new small file; Conflict if there is one of this name."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} exists") from e
            raise
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def _get(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    def digest(self, rows: DataFrame) -> str:
        """Of the rows as a multiset, whatever their order and files."""
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
        return f"{found.n}-{found.h or 0}"

    def write(self, revision: str, parent: str | None, rows: DataFrame) -> str:
        """A draft becomes ready when its manifest is there; its digest is that of what can be read."""
        path = f"{self.folder}/{revision}.rows"
        rows.write.parquet(path)
        digest = self.digest(self.spark.read.schema(rows.schema).parquet(path))
        self._put(f"{revision}.json", {"parent": parent, "digest": digest})
        return digest

    def ready(self, revision: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{revision}.json"))

    def activations(self) -> list[dict]:
        found = self._fs.globStatus(self._path(f"{self.folder}/active-*.json")) or []
        names = sorted(f.getPath().getName() for f in found)
        return [self._get(n) for n in names]

    def active(self) -> str | None:
        done = self.activations()
        return done[-1]["revision"] if done else None

    def activate(self, revision: str, expected: str | None, digest: str) -> None:
        """Makes ``revision`` active if ``expected`` is active now and the digest is its own."""
        if not self.ready(revision) or self._get(f"{revision}.json")["digest"] != digest:
            raise Conflict("the revision is a draft, or its digest differs")
        done = self.activations()
        if (done[-1]["revision"] if done else None) != expected:
            raise Conflict(f"{expected} is not active")
        self._put(f"active-{len(done):08d}.json", {"revision": revision, "parent": expected})

    def lineage(self, revision: str | None) -> list[str]:
        """The revision and its ancestors; a cycle is an error."""
        out: list[str] = []
        while revision is not None:
            if revision in out:
                raise Conflict("the lineage holds a cycle")
            out.append(revision)
            revision = self._get(f"{revision}.json")["parent"]
        return out

    def resolved(self, key: str, gone: str) -> DataFrame:
        """The rows of the active revision: of each key that of the nearest ancestor, but no tombstone."""
        rows = None
        for depth, revision in enumerate(self.lineage(self.active())):
            own = self.spark.read.parquet(f"{self.folder}/{revision}.rows").withColumn("depth", F.lit(depth).cast("bigint"))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            raise Conflict("nothing is active")
        kept = [c for c in rows.columns if c not in (key, gone)]
        nearest = rows.groupBy(key).agg(F.min_by(F.struct(*kept, gone), "depth").alias("r"))
        return nearest.where(~F.col(f"r.{gone}")).select(key, *(F.col(f"r.{c}") for c in kept))
