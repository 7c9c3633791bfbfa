"""The change feed: exactly-once append of messages, and reading it back.

``<root>/data/version=v/status=s/project=p/table=t``: one dataset for all tables
and, under another status, for the rejected messages and tombstones. A ledger entry has
one row per topic partition. Next to it, ``<root>/offsets/version=v`` holds the set of all
committed offsets (``offsets``), written by many tasks before the entry makes it count, so
what is new in a batch is told by one small version and not by the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import envelope, offsets, running
from tidemark.sources import ledger

ENTRY = "topic STRING, partition INT, min_offset BIGINT, max_offset BIGINT, rows BIGINT, commit_ts TIMESTAMP"
STORED = (
    "topic STRING, partition INT, offset BIGINT, reason STRING, _op STRING, _ts_ms BIGINT, "
    "_deleted BOOLEAN, data STRING, version BIGINT, status STRING, project STRING, table STRING"
)
ACCEPTED, REJECTED, EMPTY = "accepted", "rejected", "tombstone"


def offset_marks(spark: SparkSession, root: str) -> DataFrame:
    """The committed offset of every topic partition."""
    entry = _entry(spark, root, ledger.last_version(spark, root, ENTRY))
    return entry.groupBy("topic", "partition").agg(F.max("max_offset").alias("max_offset"))


def committed_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The offsets done: topic, partition, min_offset, max_offset; intervals never touch."""
    return offsets.intervals(_done(spark, root, ledger.last_version(spark, root, ENTRY)))


def _entry(spark: SparkSession, root: str, version: int) -> DataFrame:
    entry = ledger.entries(spark, root, ENTRY).filter(F.col("version") == version)
    return entry.select("topic", "partition", "min_offset", "max_offset")


def _done(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The set of offsets committed up to a version."""
    stored = ledger.read_or_empty(spark, f"{root}/offsets/version={version}", offsets.DONE)
    if version < 0 or stored.inputFiles():
        return stored
    # The entry of a feed from before there was a set has the intervals themselves.
    return _entry(spark, root, version).withColumn("bits", F.lit(None).cast("array<bigint>"))


def append(messages: DataFrame, root: str, prefix: str = "cdc", ordered: bool = False) -> int | None:
    """Append a batch as one version; None if all of it was there already.

    Every offset seen counts as done, also those of rejects and tombstones, and
    an offset that occurs twice in the batch is appended once. ``ordered`` says
    that the source delivers a topic partition in offset order, so that the
    marks alone tell what is new; else offsets are compared with the intervals.
    """
    spark = messages.sparkSession
    last = ledger.last_version(spark, root, ENTRY)
    version, done = last + 1, _done(spark, root, last)
    # An ordered source has delivered all there is below its mark.
    known = offset_marks(spark, root).withColumn("min_offset", F.lit(-(2**63))) if ordered else done
    fresh = offsets.fresh(messages, known)
    rows = envelope.normalize(fresh, prefix)
    status = (
        F.when(F.col("reason").isNull(), ACCEPTED)
        .when(F.col("reason") == envelope.TOMBSTONE, EMPTY)
        .otherwise(REJECTED)
    )
    # Few files per table, and several writers for a table that is most of a batch.
    sized = rows.withColumn("status", status).hint("rebalance", "status", "project", "table")
    path = f"{root}/data/version={version}"
    sized.write.mode("overwrite").partitionBy("status", "project", "table").parquet(path)

    written = ledger.read_or_empty(spark, path, STORED.replace("version BIGINT, ", ""))
    if not written.inputFiles():
        return None
    offsets.added(done, written).write.mode("overwrite").parquet(f"{root}/offsets/version={version}")
    # Of a topic partition: the first and last offset so far, and the new rows.
    accepted = F.when(F.col("status") == ACCEPTED, 1).otherwise(0)
    new = written.filter(F.col("offset").isNotNull()).select(
        "topic", "partition", F.col("offset").alias("min_offset"), F.col("offset").alias("max_offset"), accepted.alias("rows")
    )
    old = _entry(spark, root, last).withColumn("rows", F.lit(0))
    entry = old.unionByName(new).groupBy("topic", "partition").agg(
        F.min("min_offset").alias("min_offset"),
        F.max("max_offset").alias("max_offset"),
        F.sum("rows").alias("rows"),
        F.current_timestamp().alias("commit_ts"),
    )
    ledger.commit(entry, root, version)
    return version


def append_limited(
    messages: DataFrame, root: str, max_records: int, prefix: str = "cdc", ordered: bool = False
) -> list[int]:
    """Append a batch as versions of at most ``max_records`` messages each, in the order of offsets.

    For sources that cannot bound a batch themselves. The batch is numbered by a prefix
    scan and staged once, cut where the numbers say, also inside a file; then every cut
    is an append of its own. A crash between them is made good by running the batch
    again: what is committed is not new.
    """
    if max_records < 1:
        raise ValueError(f"max_records must be at least 1, not {max_records}")
    spark = messages.sparkSession
    rows = messages.withColumn("_all", F.lit(0))
    cuts = running.find_cuts(rows, ["_all"], offsets.OFFSET)
    before = {"_before": running.Measure("count", F.lit(True))}
    numbered = running.running_before(cuts.assign(rows), cuts, before)
    piece = F.floor(F.col("_before") / max_records).cast("int").alias("_piece")
    staged = numbered.select(*messages.columns, piece).hint("rebalance", "_piece")
    path = f"{root}/staged"
    staged.write.mode("overwrite").partitionBy("_piece").parquet(path)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    batch = ledger.read_or_empty(spark, path, f"{ddl}, _piece INT")
    versions = []
    for p in sorted(ledger.partition_values(batch, "_piece")):
        one = batch.filter(F.col("_piece") == p).drop("_piece")
        versions.append(append(one, root, prefix, ordered))
    return [v for v in versions if v is not None]


def _committed(spark: SparkSession, root: str) -> DataFrame:
    last = ledger.last_version(spark, root, ENTRY)
    stored = ledger.read_or_empty(spark, f"{root}/data", STORED)
    # Versions are committed in order: a constant bound, pruned at planning.
    return stored.filter(F.col("version") <= last)


def read_feed(spark: SparkSession, root: str) -> DataFrame:
    """All feed rows of committed versions."""
    rows = _committed(spark, root).filter(F.col("status") == ACCEPTED)
    return rows.drop("status", "reason")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    rows = _committed(spark, root).filter(F.col("status") == REJECTED)
    return rows.select("topic", "partition", "offset", "reason", "version")


def read_table(spark: SparkSession, root: str, project: str, table: str, columns: str) -> DataFrame:
    """The feed of one table with declared columns; other tables are pruned."""
    one = (F.col("project") == project) & (F.col("table") == table)
    return envelope.decode(read_feed(spark, root).filter(one), columns)


def register_view(spark: SparkSession, root: str, project: str, table: str, columns: str) -> str:
    """Make the feed of one table queryable as ``proj_<project>_<table>``."""
    name = f"proj_{project}_{table}"
    read_table(spark, root, project, table, columns).createOrReplaceTempView(name)
    return name


def history(entries: DataFrame) -> DataFrame:
    """The commits of a feed, from its ledger entries."""
    return entries.groupBy("version").agg(
        F.lit("append").alias("operation"),
        F.max("commit_ts").alias("commit_ts"),
        F.sum("rows").alias("rows"),
    )


def read_history(spark: SparkSession, root: str) -> DataFrame:
    return history(ledger.entries(spark, root, ENTRY))
