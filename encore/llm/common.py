"""What the training-data operators share: tables, the shared folder, and files in it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from encore.session import materialized, new_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The URI of a new folder in the shared folder of the session."""
    ship(spark)
    return new_folder(spark)


written = materialized


@contextmanager
def keeping() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that keeps what is used several times on executors' disks, until the block ends.

    Kept rows have their lineage: those of a lost executor are made again. Not for loops,
    where each round would hold the plans of all before.
    """
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    try:
        yield keep
    finally:
        for df in held:
            df.unpersist()


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``taken`` has that name."""
    taken = {t.lower() for t in taken}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def slices(batch: pa.RecordBatch, column: str | int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``rows`` rows and ``size`` bytes of the column.

    A longer value is a part of its own.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


@contextmanager
def new_file(uri: str) -> Iterator:
    """A binary stream to ``uri``. The file appears under its name only when whole.

    Every call writes to a name of its own and renames it at the end, so a second
    attempt of a lost task never mixes with the first.
    """
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


@contextmanager
def old_file(uri: str) -> Iterator:
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        yield f
