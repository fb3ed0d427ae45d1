"""All queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.plans import oracles
from gridspark.plans import queries as q


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of every component on every carrier."""
    return q.entry(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.ORACLES.items() if name in q.QUERIES}
