"""Registry of the runnable queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query builder under ``name``, with its oracle when SQL can state it."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# Tables whose rows are long texts, so that a small file still means much work per row.
_TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A given table; text tables read in fewer splits than there are cores are spread over them, unless not asked to."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and name in _TEXTS and cores > 1 and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
