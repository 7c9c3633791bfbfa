"""Reverse stream: the net change of an inbox into the operational table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import inbox as ib
from tidemark.sources.inbox_store import ENTRY, Inbox
from tidemark.sources.keyed import KeyedTable


def process(
    spark: SparkSession,
    inbox: Inbox,
    target: KeyedTable,
    order: Sequence[str] = (),
    preimage_deletes: bool = False,
) -> int | None:
    """Apply the versions not applied yet; None if there are none.

    The version reached is committed with the rows, so a failure leaves both as
    they were. It is kept per inbox id: a re-created inbox starts anew.
    """
    source, current = inbox.dataset(spark), inbox.version(spark)
    last = target.progress(spark, source)
    if current <= last:
        return None
    changes = inbox.changes(spark, after=last, upto=current)
    net = ib.net_change(changes, target.keys, order, preimage_deletes=preimage_deletes, op=ib.MARK)
    target.merge(net, source=source, source_version=current, op=ib.MARK)
    return current


def process_all(
    spark: SparkSession,
    routes: Mapping[str, tuple[Inbox, KeyedTable]],
    order: Sequence[str] = (),
    preimage_deletes: bool = False,
) -> dict[str, int | None | Exception]:
    """``process`` for every inbox and its table, by name; several inboxes may share a table.

    An inbox that fails stops none of the others; its error is its result, and
    its progress stays, so the next round tries it again.
    """
    done: dict[str, int | None | Exception] = {}
    for name, (inbox, target) in routes.items():
        try:
            done[name] = process(spark, inbox, target, order, preimage_deletes)
        except Exception as error:  # noqa: BLE001 - handed to the caller
            done[name] = error
    return done


def start(
    spark: SparkSession,
    inbox: Inbox,
    target: KeyedTable,
    checkpoint: str,
    interval: str | None = "10 seconds",
    order: Sequence[str] = (),
    preimage_deletes: bool = False,
) -> StreamingQuery:
    """Run ``process`` whenever the inbox has a new commit.

    The stream only tells that there are commits. What is applied goes by version
    and never splits one, in whatever order their files are seen.
    """
    schema = f"version BIGINT, {ENTRY}"
    commits = spark.readStream.schema(schema).parquet(f"{inbox.root}/ledger")

    def run(batch, _batch_id: int) -> None:
        session = batch.sparkSession
        session.conf.set("spark.sql.adaptive.enabled", "true")
        process(session, inbox, target, order, preimage_deletes)

    writer = commits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
