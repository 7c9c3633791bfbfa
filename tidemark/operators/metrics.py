"""Feed metrics from ledger entries: counters, lag and rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.envelope import route


def counters(ledger: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Rows written and commits made, per table."""
    routed = route(ledger, prefix).filter(F.col("project").isNotNull())
    return routed.groupBy("project", "table").agg(
        F.sum("rows").alias("rows"),
        F.count_distinct(F.when(F.col("rows") > 0, F.col("version"))).alias("flushes"),
    )


def lag(ends: DataFrame, marks: DataFrame, group: Sequence[str]) -> DataFrame:
    """Messages not yet committed, summed over the partitions of each group.

    ``ends`` has the group columns, topic, partition and ``end_offset``; an
    uncommitted partition lags by all its messages.
    """
    joined = ends.join(marks, ["topic", "partition"], "left")
    behind = F.col("end_offset") - F.coalesce("max_offset", F.lit(-1))
    return joined.groupBy(*group).agg(F.sum(F.greatest(behind, F.lit(0))).alias("lag"))


def rate(ledger: DataFrame, window: str = "1 minute", late: str = "5 minutes", prefix: str = "cdc") -> DataFrame:
    """Rows per second of each table in tumbling windows of commit time.

    Works on a batch of ledger entries and on a stream of them.
    """
    timed = route(ledger, prefix).filter(F.col("project").isNotNull()).withWatermark("commit_ts", late)
    span = F.window("commit_ts", window)
    summed = timed.groupBy("project", "table", span.alias("_w")).agg(F.sum("rows").alias("rows"))
    start, end = F.unix_seconds("_w.start"), F.unix_seconds("_w.end")
    return summed.select(
        "project",
        "table",
        start.alias("window_start"),
        "rows",
        (F.col("rows") / (end - start)).alias("rows_per_second"),
    )
