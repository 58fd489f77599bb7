"""Operator 8: WARC archives, one gzip member per record, and their sequential reader.

``write_archives`` writes the rows of a pages table as WARC/1.1 files into the shared
folder and returns the table of what was written; ``read_archives`` streams those files
record by record. A payload of at least ``MIN_REVISIT`` bytes that several pages hold is
stored once, as a response, with the page of the largest id; the others are revisit
records that refer to it. Equal payloads are those of equal SHA-1 digest and length.

Defined results: a null payload is empty; a null url is written as ``urn:page:<id>``; rows
of equal id and payload are all responses where that id is the largest of its group, since
they are the same page; rows of null id never serve others, and revisit the group's
response if there is one; an empty table gives no archives and no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.common import new_file, old_file, shared_dir, table, written

MIN_REVISIT = 1000
#: An archive is closed after so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
CHUNK = 64 << 10
#: Records have no time of their own in the tables; a fixed one keeps reruns alike.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    #: The digest and length of the block as read.
    sha1: str
    length: int
    block: bytes | None = field(default=None, repr=False)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return b"".join((packer.compress("\r\n".join(lines).encode()), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


class _Framer:
    """Splits the bytes of one inflated member into head, block and tail as they come."""

    def __init__(self, keep: bool):
        self.head, self.headers, self.left, self.tail = bytearray(), None, 0, bytearray()
        self.sha, self.length, self.kept = hashlib.sha1(), 0, bytearray() if keep else None

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            version, *lines = self.head[:end].decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise WarcError(f"not a WARC record: {version[:40]!r}")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.left = self.length = int(self.headers["content-length"])
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.sha.update(block)
        if self.kept is not None:
            self.kept += block
        self.tail += rest

    def close(self) -> Record:
        if self.headers is None or self.left or self.tail != b"\r\n\r\n":
            raise WarcError("a record's block does not end where its content length says")
        digest = self.sha.hexdigest()
        told = self.headers.get("warc-block-digest")
        if told and told != f"sha1:{base32(digest)}":
            raise WarcError(f"block digest differs in {self.headers.get('warc-record-id')}")
        payload = self.headers.get("warc-payload-digest")
        if self.headers["warc-type"] != "revisit" and payload and payload != f"sha1:{base32(digest)}":
            raise WarcError(f"payload digest differs in {self.headers.get('warc-record-id')}")
        return Record(self.headers, digest, self.length, None if self.kept is None else bytes(self.kept))


def records(stream, keep_blocks: bool = False) -> Iterator[Record]:
    """The records of an archive in order. Memory: one chunk, and one block if kept."""
    inflater, framer, pending = zlib.decompressobj(31), None, b""
    while True:
        data = pending or stream.read(CHUNK)
        pending = b""
        if not data:
            if framer is not None:
                raise WarcError("the archive ends within a record")
            return
        framer = framer or _Framer(keep_blocks)
        try:
            framer.feed(inflater.decompress(data, CHUNK))
            while inflater.unconsumed_tail and not inflater.eof:
                framer.feed(inflater.decompress(inflater.unconsumed_tail, CHUNK))
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from e
        if inflater.eof:
            yield framer.close()
            pending, inflater, framer = bytes(inflater.unused_data), zlib.decompressobj(31), None


def planned(pages: DataFrame, key: str, url: str, payload: str, min_revisit: int) -> DataFrame:
    """key, url, body, sha1, bytes and refers_to of each row, by equal payloads.

    The groups are formed on digests by a partial aggregate. Only groups of two or more
    rows are joined back; a left join, whose large partitions Spark can split.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"sha1": F.sha1("body"), "bytes": F.octet_length("body").cast("long")})
    groups = rows.where(F.col("bytes") >= min_revisit).groupBy(F.col("sha1").alias("g_sha1"), F.col("bytes").alias("g_bytes")).agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 AND first IS NOT NULL").drop("n")
    joined = rows.join(groups, (F.col("sha1") == F.col("g_sha1")) & (F.col("bytes") == F.col("g_bytes")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("key", "url", "body", "sha1", refers.alias("refers_to"))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows; returns path, records and bytes of each archive, from the shared folder."""
    folder = shared_dir(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        rows = (row for b in batches for row in zip(*(b.column(c) for c in ("key", "url", "body", "sha1", "refers_to")), strict=True))
        row, done = next(rows, None), []
        while row is not None:
            path = f"{name}-{len(done):04d}.warc.gz"
            n = size = 0
            with new_file(path) as out:
                while row is not None and size < archive_bytes:
                    key_, url_, body, sha1, refers = (x.as_py() for x in row)
                    record_id = f"urn:page:{'' if key_ is None else key_}"
                    digest = base32(sha1)
                    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", "".join((url_ or record_id).split())), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    if refers is None:
                        headers.append(("WARC-Block-Digest", f"sha1:{digest}"))
                    else:
                        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("X-Payload-Length", str(len(body)))]
                    size += out.write(member(headers, body if refers is None else b""))
                    n += 1
                    row = next(rows, None)
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    # Written once: were the manifest computed again, the archives would be written again.
    return written(planned(pages, key, url, payload, min_revisit).mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, parallel: int | None = None) -> DataFrame:
    """One row per record of the archives named in column ``path``, each digest verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        number = lambda text: int(x) if (x := text.strip("<>").removeprefix("urn:page:")) else None

        def rows(path: str) -> Iterator[tuple]:
            with old_file(path) as f:
                for r in records(f):
                    h = r.headers
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = h.get("warc-refers-to")
                    yield number(h["warc-record-id"]), h["warc-type"], r.length if refers is None else int(h["x-payload-length"]), digest, number(refers) if refers else None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        found: list[tuple] = []
        for b in batches:
            for path in b.column("path").to_pylist():
                for row in rows(path):
                    found.append(row)
                    if len(found) == 5000:
                        yield batch(found)
                        found = []
        if found:
            yield batch(found)

    parallel = parallel or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select("path").repartition(parallel)
    return spread.mapInArrow(read, "record_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, encode(COALESCE(html, ''))::BLOB AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p
), g AS (
  SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
