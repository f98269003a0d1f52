"""Where the check modules register their queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows if there is any."""

    def register(query):
        @functools.wraps(query)
        def in_utc(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register
