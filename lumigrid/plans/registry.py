"""Every checked query: a function of (spark, sf_dir), and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def checked(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Event times of the test tables carry no zone and are read as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register
