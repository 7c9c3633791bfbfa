"""All registered queries and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import feed_queries, inbox_queries, metric_queries, stream_queries, type_queries

_GROUPS = (feed_queries, inbox_queries, type_queries, metric_queries, stream_queries)


def _in_utc(query: Callable[[SparkSession, str], DataFrame]):
    """Event times are stored without a zone and mean UTC."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(q) for group in _GROUPS for name, q in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
