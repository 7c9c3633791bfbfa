"""Incremental current state: the latest change of each key, kept up to date.

Two ways. ``changed_state`` is a streaming aggregation: the state store holds the
latest change of each key, and every batch hands on the keys it touched, to any
sink; ``start_changes`` appends them to a log that ``live_changes`` reads. ``start``
folds each batch into a stored table by rewriting the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import collapse, envelope, inbox
from tidemark.sources import ledger
from tidemark.sources.keyed import KeyedTable

# Keeps its state on disk beside the heap; the durable copy lies in the checkpoint.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "base BOOLEAN, commit_ts TIMESTAMP"
MARKS = "_op STRING, _ts_ms BIGINT, _deleted BOOLEAN, partition INT, offset BIGINT"


def state_table(root: str, columns: str, keys: tuple[str, ...], buckets: int = 64) -> KeyedTable:
    """Where the state lives: the data columns and the marks of the last change.

    Deleted keys stay, so that a late older change cannot bring them back.
    """
    return KeyedTable(root, f"project STRING, table STRING, {columns}, {MARKS}", ("project", "table", *keys), buckets)


def _keyed_rows(messages: DataFrame, columns: str, keys: Sequence[str], prefix: str, on_missing_key: str) -> DataFrame:
    rows = envelope.normalize_typed(messages, columns, prefix).drop("topic")
    return inbox.with_keys(rows, keys, on_missing_key)


def fold(
    messages: DataFrame, columns: str, state: KeyedTable, prefix: str = "cdc", on_missing_key: str = "reject"
) -> int:
    """Bring one batch of messages into the state; folding it again changes nothing.

    Messages without a value of their key are left out, or fail the batch.
    """
    rows = _keyed_rows(messages, columns, state.keys, prefix, on_missing_key)
    newest = collapse.latest_per_key(rows, state.keys, collapse.FEED_ORDER)

    def combine(held: DataFrame, new: DataFrame) -> DataFrame:
        both = held.unionByName(new)
        return collapse.latest_per_key(both, state.keys, collapse.FEED_ORDER)

    return state.rewrite(newest, combine)


def start(
    messages: DataFrame,
    columns: str,
    state: KeyedTable,
    checkpoint: str,
    interval: str | None = "10 seconds",
    prefix: str = "cdc",
    on_missing_key: str = "reject",
) -> StreamingQuery:
    def run(batch: DataFrame, _batch_id: int) -> None:
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        fold(batch, columns, state, prefix, on_missing_key)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(interval)).start()


def _trigger(interval: str | None) -> dict:
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def live_rows(spark: SparkSession, state: KeyedTable) -> DataFrame:
    return state.read(spark).filter(~F.col("_deleted"))


def changed_state(
    messages: DataFrame,
    columns: str,
    keys: Sequence[str],
    prefix: str = "cdc",
    on_missing_key: str = "reject",
) -> DataFrame:
    """The latest change of each key, deleted or not, as an aggregation of the messages.

    Over a stream, written in update mode, a batch gives the keys it touched and
    no others, each once. Tasks combine before the shuffle, so a key with most of
    the messages sends one row a task. A late older change and a repeated message
    touch their key and leave its value. The state has one row per key.
    """
    rows = _keyed_rows(messages, columns, keys, prefix, on_missing_key)
    by = ["project", "table", *keys]
    held = [c for c in rows.columns if c not in by]
    newest = F.max_by(F.struct(*held), F.struct(*collapse.FEED_ORDER))
    return rows.groupBy(*by).agg(newest.alias("_newest")).select(*by, "_newest.*")


def start_changes(
    messages: DataFrame,
    columns: str,
    keys: Sequence[str],
    root: str,
    checkpoint: str,
    interval: str | None = "10 seconds",
    prefix: str = "cdc",
    on_missing_key: str = "reject",
) -> StreamingQuery:
    """Append the keys every batch touched to a log, one version a batch.

    A restart goes on from the checkpoint. If that is lost, messages are read
    again and the log tells the newest by the marks of the rows, so nothing
    repeated or older can win.
    """
    messages.sparkSession.conf.set(STORE, ROCKSDB)

    def run(batch: DataFrame, _batch_id: int) -> None:
        _add(batch, root, base=False)

    changed = changed_state(messages, columns, keys, prefix, on_missing_key)
    writer = changed.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(interval)).start()


def _add(rows: DataFrame, root: str, base: bool) -> int:
    spark = rows.sparkSession
    version = ledger.last_version(spark, root, ENTRY) + 1
    rows.write.mode("overwrite").parquet(f"{root}/data/version={version}")
    entry = spark.range(1).select(F.lit(base).alias("base"), F.current_timestamp().alias("commit_ts"))
    ledger.commit(entry, root, version)
    return version


def _logged(spark: SparkSession, columns: str, keys: Sequence[str], root: str) -> DataFrame:
    """The latest row of each key in the last base and the versions after it."""
    entries = ledger.entries(spark, root, ENTRY)
    ends = entries.agg(F.max("version").alias("last"), F.max(F.when(F.col("base"), F.col("version"))).alias("base")).first()
    schema = f"project STRING, table STRING, {columns}, {MARKS}, version BIGINT"
    stored = ledger.read_or_empty(spark, f"{root}/data", schema)
    first = -1 if ends["base"] is None else ends["base"]
    last = -1 if ends["last"] is None else ends["last"]
    mine = stored.filter(F.col("version").between(first, last)).drop("version")
    return collapse.latest_per_key(mine, ["project", "table", *keys], collapse.FEED_ORDER)


def live_changes(spark: SparkSession, columns: str, keys: Sequence[str], root: str) -> DataFrame:
    """The live rows by the log of ``start_changes``."""
    return _logged(spark, columns, keys, root).filter(~F.col("_deleted"))


def compact(spark: SparkSession, columns: str, keys: Sequence[str], root: str) -> int:
    """Make one base version of the log, so that readers skip all before it.

    Deleted keys stay in it, for late older changes. One writer per log: run it
    while the stream is stopped, or from its own batches.
    """
    return _add(_logged(spark, columns, keys, root), root, base=True)
