"""Sequential grouping within keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def greedy_clusters(rows: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """keys, value and the cluster of each row: the first whose leader is within ``width``.

    A row may found a cluster that later rows join, which no window expresses. Rows come
    sorted by key and value, many keys to a task; only the last leader is kept, as values
    ascend and no earlier leader can be nearer.
    """
    names = [*keys, value]
    kinds = dict(rows.dtypes)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leader = None, 0
        for b in batches:
            out = []
            for *key, v in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if key != current or v - leader > width:
                    current, leader = key, v
                out.append(leader)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], [*names, "leader"])

    ordered = rows.select(*names).repartition(*keys).sortWithinPartitions(*names)
    return ordered.mapInArrow(cluster, ", ".join(f"{c} {kinds[c]}" for c in names) + ", leader bigint")
