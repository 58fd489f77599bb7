"""A source of pages that lead to one another by a cursor, and the class of their coverage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Walk:
    rows: list[dict] = field(default_factory=list)
    coverage: str = "complete"


def follow(fetch: Callable[[str], dict | None], start: str, expected: int | None = None) -> Walk:
    """Pages ``{"rows": [...], "next": cursor or null}`` from ``start`` on.

    The walk is partial if a page is missing, a cursor-loop if a cursor comes again,
    no-progress if a page brings no new row, and a count-mismatch if the rows are fewer or
    more than expected by over three and over one percent.
    """
    walk, seen, known, cursor = Walk(), set(), set(), start
    while cursor is not None:
        if cursor in seen:
            walk.coverage = "cursor-loop"
            return walk
        seen.add(cursor)
        page = fetch(cursor)
        if page is None:
            walk.coverage = "partial"
            return walk
        fresh = [r for r in page["rows"] if json.dumps(r, sort_keys=True) not in known]
        known.update(json.dumps(r, sort_keys=True) for r in fresh)
        walk.rows += fresh
        if not fresh and page["next"] is not None:
            walk.coverage = "no-progress"
            return walk
        cursor = page["next"]
    if expected is not None and abs(len(walk.rows) - expected) > max(3, expected * 0.01):
        walk.coverage = "count-mismatch"
    return walk


class _Start(InputPartition):
    def __init__(self, start: str):
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.starts = json.loads(options["pages"]), options["starts"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_Start(s) for s in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        walk = follow(self.pages.get, partition.start)
        for r in walk.rows:
            yield partition.start, json.dumps(r, sort_keys=True), walk.coverage


class CursorSource(DataSource):
    """``spark.read.format("cursor_pages")``: one task per starting cursor.

    Options: ``starts``, comma-separated; ``pages``, a JSON object of stored pages by cursor.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "start string, row string, coverage string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
