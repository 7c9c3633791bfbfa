"""Change message sources: a Kafka topic pattern, files, or an initial snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "topic STRING, partition INT, offset BIGINT, value STRING"


def read_messages(messages: DataFrame, pattern: str) -> DataFrame:
    """The messages of every topic that matches a pattern in full."""
    matching = messages.filter(F.col("topic").rlike(f"^(?:{pattern})$"))
    return matching.select("topic", "partition", "offset", "value")


def stream_files(
    spark: SparkSession,
    path: str,
    pattern: str = r"cdc\..*",
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of message files, from the first one on.

    Files may arrive in any order and overlap.
    """
    reader = spark.readStream.schema(MESSAGE_SCHEMA).format(file_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return read_messages(reader.load(path), pattern)


def snapshot_rows(
    rows: DataFrame, project: str, table: str, ts_ms: int, op: str = "r"
) -> DataFrame:
    """Existing rows of a table as feed rows, so that a feed starts complete.

    Decimals are written as text, as the change messages carry them.
    """
    fields = [
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() == "decimal"
        else F.col(f.name)
        for f in rows.schema.fields
    ]
    return rows.select(
        F.lit(project).alias("project"),
        F.lit(table).alias("table"),
        F.lit(op).alias("_op"),
        F.lit(ts_ms).cast("bigint").alias("_ts_ms"),
        F.lit(False).alias("_deleted"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("data"),
    )
