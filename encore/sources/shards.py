"""Packing of rows into parts of bounded size, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, bucket: str, key: str, size: str, limit: int) -> DataFrame:
    """bucket, key and part of each row. A row that is larger than the limit is an error.

    The sum starts anew whenever it would pass the limit, which no window frame expresses;
    the rows of a bucket come in order, a batch at a time, and only the sum is kept.
    """

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for p in parts:
            out = []
            if (p[size] > limit).any():
                raise ValueError(f"a row of {p[size].max()} is larger than a part of {limit}")
            for b, n in zip(p[bucket], p[size], strict=True):
                total, part = held.get(b, (0, 0))
                total, part = (n, part + 1) if total and total + n > limit else (total + n, part)
                held = {b: (total, part)}  # buckets come one after another
                out.append(part)
            yield pd.DataFrame({bucket: p[bucket], key: p[key], "part": out})

    ordered = rows.select(bucket, key, F.col(size).alias(size)).repartition(bucket).sortWithinPartitions(bucket, key)
    kinds = {n: t for n, t in rows.dtypes}
    return ordered.mapInPandas(pack, f"{bucket} {kinds[bucket]}, {key} {kinds[key]}, part bigint")
