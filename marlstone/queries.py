"""Registry of the library's own queries: a function of (spark, sf_dir), and its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a function of Tables under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All registered queries and their SQL."""
    from .plans import analytics_queries, catalogue_queries, claim_queries, evaluation_queries, ingestion_queries, record_queries, result_queries, retrieval_queries, streaming_queries, telemetry_queries  # noqa: F401

    return QUERIES, ORACLES
