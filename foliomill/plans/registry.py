"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and SQL by name, in order of definition."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of the views several queries use.
CURRENT = """
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, idx ORDER BY fetched_at DESC NULLS LAST, chapter_id DESC) AS rn FROM chapters)
  WHERE rn = 1
)"""
LISTING = """
refs AS (
  SELECT book_id, idx, title, url FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id, idx ORDER BY received_at DESC NULLS LAST, listed_at DESC NULLS LAST, url, title) AS rn FROM chapter_refs)
  WHERE rn = 1
)"""
