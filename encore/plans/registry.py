"""Registration of query/oracle pairs by key."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from encore.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Maps a query key to its Spark query and, where SQL can express it, its oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def register(self, key: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            if key in self.queries:
                raise ValueError(f"duplicate query key {key}")

            @wraps(query)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return query(spark, sf_dir)

            self.queries[key] = run
            if oracle is not None:
                self.oracles[key] = oracle
            return query

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
