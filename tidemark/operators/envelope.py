"""Change messages: routing, normalising, rejecting and unwrapping.

A message has ``topic STRING, partition INT, offset BIGINT, value STRING``. All
steps are projections, so the same functions serve a batch and a stream.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_text import META_PREFIX, is_data_field

# Reasons a message leads to no feed row.
BAD_TOPIC = "bad_topic"
INVALID_JSON = "invalid_json"
NO_DATA = "no_data_columns"
TOMBSTONE = "tombstone"


def topic_pattern(prefix: str = "cdc") -> str:
    """prefix.<project>.proj_<project>.<table>, both project parts being equal."""
    return rf"^{re.escape(prefix)}\.([a-z0-9_]+)\.proj_\1\.([A-Za-z0-9_]+)$"


def storage_location(project: Column, table: Column, bucket: str = "warehouse") -> Column:
    return F.concat_ws("/", F.lit(f"s3://{bucket}"), project, table)


def route(messages: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Add ``project`` and ``table``, both null where the topic is not ours."""
    pattern = topic_pattern(prefix)
    return messages.withColumns(
        {
            "project": F.nullif(F.regexp_extract("topic", pattern, 1), F.lit("")),
            "table": F.nullif(F.regexp_extract("topic", pattern, 2), F.lit("")),
        }
    )


def _reason(value: Column, has_data: Column) -> Column:
    no_state = value.isNull() | F.trim(value).isin("", "null")
    not_an_object = F.when(no_state, TOMBSTONE).otherwise(INVALID_JSON)
    return (
        F.when(F.col("project").isNull(), BAD_TOPIC)
        .when(has_data.isNull(), not_an_object)
        .when(~has_data, NO_DATA)
    )


def _op(text: Column) -> Column:
    # A missing, empty or null operation is an initial snapshot read.
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("r"))


def _deleted(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def normalize(messages: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Split each message into data and change marks, keeping every message.

    ``reason`` is null for a feed row and says otherwise why there is none.
    ``data`` is the JSON text of the data fields; nested values in it have sorted
    keys and no spaces.
    """
    parsed = _parsed(route(messages, prefix))
    reasoned = parsed.withColumn("reason", _reason(F.col("value"), _has_data()))
    return _split(reasoned, F.when(F.col("reason").isNull(), F.col("_fields")), ["reason"])


def feed_rows(messages: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Only the messages that lead to a feed row, in the form of ``normalize``."""
    usable = F.col("project").isNotNull() & _has_data()
    return _split(_parsed(route(messages, prefix)).filter(usable), F.col("_fields"), [])


def _parsed(messages: DataFrame) -> DataFrame:
    """Add ``_fields``, the fields of the message, null unless its text is exactly one JSON object.

    Every reader of messages decides by this parse. Text after the object, single
    quotes, numbers JSON does not have and fields that occur twice, at any depth, make
    a message invalid. The parser stops at the end of the object; so that it sees what
    follows, the text is parsed as the first of two elements, the second of which no
    text can foresee.
    """
    end = F.xxhash64("value")
    text = F.concat(F.lit("["), F.col("value"), F.lit(',{"end":'), end.cast("string"), F.lit("}]"))
    strict = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
    parts = F.from_json(text, "array<map<string,variant>>", strict)

    def alone(found: Column) -> Column:
        names = F.map_keys(F.get(found, 0))
        last = F.try_variant_get(F.get(found, 1)["end"], "$", "bigint")
        whole = (F.size(found) == 2) & (last == end) & (F.size(names) == F.size(F.array_distinct(names)))
        return F.when(whole, F.get(found, 0))

    # A lambda, so that the text is parsed once also where a filter takes this expression.
    return messages.withColumn("_fields", F.get(F.transform(F.array(parts), alone), 0))


def _has_data() -> Column:
    return F.exists(F.map_keys("_fields"), is_data_field)


def _split(messages: DataFrame, fields: Column, extra: list[str]) -> DataFrame:
    parsed = messages.withColumn("_fields", fields)

    def meta(name: str) -> Column:
        return F.try_variant_get(F.col("_fields")[META_PREFIX + name], "$", "string")

    data = F.map_filter("_fields", lambda k, _: is_data_field(k))
    ok = F.col("_fields").isNotNull()
    return parsed.select(
        "topic",
        "partition",
        "offset",
        "project",
        "table",
        *extra,
        F.when(ok, _op(meta("op"))).alias("_op"),
        F.when(ok, meta("ts_ms").try_cast("bigint")).alias("_ts_ms"),
        F.when(ok, _deleted(meta("deleted"))).alias("_deleted"),
        F.when(ok, F.to_json(data)).alias("data"),
    )


def rejects(messages: DataFrame, prefix: str = "cdc") -> DataFrame:
    """Messages that break the contract, with the reason. Tombstones do not."""
    reasoned = _parsed(route(messages, prefix)).withColumn("reason", _reason(F.col("value"), _has_data()))
    bad = F.col("reason").isNotNull() & (F.col("reason") != TOMBSTONE)
    return reasoned.filter(bad).select("topic", "partition", "offset", "reason", "value")


def normalize_typed(messages: DataFrame, columns: str, prefix: str = "cdc") -> DataFrame:
    """Feed rows of messages whose data columns are declared.

    ``columns`` is a DDL column list. Only declared columns are read from the
    payload, and Catalyst prunes those nobody uses.
    """
    meta = "__op STRING, __ts_ms STRING, __deleted STRING"
    schema = f"{columns}, {meta}"
    names = [f.name for f in _ddl(columns)]
    parsed = (
        _parsed(route(messages, prefix))
        .filter(F.col("project").isNotNull() & _has_data())
        .withColumn("_row", F.from_json("value", schema))
    )
    return parsed.select(
        "topic",
        "partition",
        "offset",
        "project",
        "table",
        *[F.col(f"_row.{n}").alias(n) for n in names],
        _op(F.col("_row.__op")).alias("_op"),
        F.col("_row.__ts_ms").try_cast("bigint").alias("_ts_ms"),
        _deleted(F.col("_row.__deleted")).alias("_deleted"),
    )


def decode(feed: DataFrame, columns: str) -> DataFrame:
    """Replace the JSON text ``data`` by declared columns."""
    names = [f.name for f in _ddl(columns)]
    keep = [c for c in feed.columns if c != "data"]
    parsed = feed.withColumn("_row", F.from_json("data", columns))
    return parsed.select(*keep, *[F.col(f"_row.{n}").alias(n) for n in names])


def unwrap(messages: DataFrame) -> DataFrame:
    """Flatten nested before/after events into the form ``normalize`` reads.

    A delete becomes its last row with ``__deleted`` true; null values stay.
    """
    event = F.from_json(
        "value", "before map<string,variant>, after map<string,variant>, op string, ts_ms bigint"
    )
    parsed = messages.withColumn("_event", event)
    deleted = F.col("_event.op") == "d"
    row = F.when(deleted, F.col("_event.before")).otherwise(
        F.coalesce("_event.after", "_event.before")
    )
    marks = F.to_json(
        F.struct(
            F.col("_event.op").alias("__op"),
            F.col("_event.ts_ms").alias("__ts_ms"),
            F.coalesce(deleted, F.lit(False)).cast("string").alias("__deleted"),
        )
    )
    body = F.to_json(row)
    # Both texts are objects: drop the closing and the opening brace and join.
    inner = F.when(body == "{}", F.lit("{")).otherwise(
        F.concat(F.expr("substring(_body, 1, length(_body) - 1)"), F.lit(","))
    )
    flat = F.concat(inner, F.expr("substring(_marks, 2)"))
    return (
        parsed.withColumns({"_body": body, "_marks": marks})
        .withColumn("value", F.when(F.col("_event.op").isNotNull(), flat).otherwise(F.col("value")))
        .drop("_event", "_body", "_marks")
    )


def _ddl(columns: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).fields
