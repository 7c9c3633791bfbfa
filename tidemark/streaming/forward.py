"""Forward stream: change messages into the feed, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import feed


def start(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = "5 seconds",
    prefix: str = "cdc",
    ordered: bool = False,
    max_records: int | None = None,
) -> StreamingQuery:
    """Append every micro-batch as one feed version, or as several of ``max_records``.

    ``interval`` None takes what is there and stops; else a batch is taken once in
    that time. The size of a batch is best set on the source
    (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``); ``max_records`` bounds the
    messages of a version whatever the source hands over. A batch that is
    run again, even after its checkpoint is lost, appends only what is not yet in
    the feed. ``ordered`` is for sources that keep the order of offsets, such as a
    broker; files need not keep it.
    """

    def append(batch: DataFrame, _batch_id: int) -> None:
        # Streams turn adaptive execution off for their own operators; a batch
        # in here is an ordinary query and sizes its files with it.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        if max_records is None:
            feed.append(batch, root, prefix, ordered)
        else:
            feed.append_limited(batch, root, max_records, prefix, ordered)

    writer = messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
