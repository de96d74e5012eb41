"""The registered queries: name, Spark function, and the SQL it must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skygauge.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load() -> None:
    """Import the modules that register queries; their Python parts travel with the tasks."""
    ship()
    from catalog import core_queries, feed_queries, job_queries, monitoring_queries  # noqa: F401
