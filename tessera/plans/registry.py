"""All queries of the engine with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when they are imported.
MODULES = ("query_language", "store_queries", "text_queries", "history_queries", "graph_queries", "code_queries", "curation_queries", "retrieval_queries", "routing_queries", "vector_queries", "scan_queries", "stream_queries", "secondary_queries", "surface_queries")


class Tables:
    """The input tables as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


_queries: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over the tables, with the SQL for the same result where SQL can express it."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = Query(name, run, sql)
        return run

    return add


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tessera.plans.{module}")
    return _queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load()["f3_dsl_events"].run(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return q.run(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = q.name, q.run.__doc__
        return run

    return {name: bind(q) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql}
