"""Typed reads of the raw feed, and what the casts lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.encode import array_of, element_of, encode
from tidemark.functions.type_map import declare


def _raw(feed: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    texts = ", ".join(f"`{name}` STRING" for name, _ in columns)
    return feed.withColumn("_raw", F.from_json("data", texts))


def typed_feed(
    feed: DataFrame, columns: Sequence[tuple[str, str]], epoch_unit: str | None = None
) -> DataFrame:
    """Cast the JSON text ``data`` to declared (name, operational type) columns."""
    declared = declare(feed.sparkSession, columns)
    keep = [c for c in feed.columns if c != "data"]
    return _raw(feed, columns).select(*keep, *[_typed(d, epoch_unit) for d in declared])


def _typed(d, epoch_unit: str | None) -> Column:
    raw = F.col(f"_raw.{d['name']}")
    value = encode(raw, d["encoding"], d["lake_type"], d["pg_type"], epoch_unit, d["element"])
    return value.alias(d["name"])


def cast_report(
    feed: DataFrame, columns: Sequence[tuple[str, str]], epoch_unit: str | None = None
) -> DataFrame:
    """Per column: values present, lost to null by the cast, and altered by it.

    One aggregation over the feed, whatever the number of columns.
    """
    declared = declare(feed.sparkSession, columns)
    both = _raw(feed, columns).select(
        "_raw", F.struct(*[_typed(d, epoch_unit) for d in declared]).alias("_new")
    )
    counts = []
    for d in declared:
        raw, new = F.col(f"_raw.{d['name']}"), F.col(f"_new.{d['name']}")
        counts += [
            F.count(raw).alias(f"present_{d['position']}"),
            F.count_if(raw.isNotNull() & new.isNull()).alias(f"nulled_{d['position']}"),
            F.count_if(new.isNotNull() & _altered(raw, new, d)).alias(f"altered_{d['position']}"),
        ]
    totals = both.agg(*counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(d["name"]).alias("name"),
                F.lit(d["pg_type"]).alias("pg_type"),
                F.lit(d["lake_type"]).alias("lake_type"),
                F.col(f"present_{d['position']}").alias("present"),
                F.col(f"nulled_{d['position']}").alias("nulled"),
                F.col(f"altered_{d['position']}").alias("altered"),
            )
            for d in declared
        ]
    )
    return totals.select(F.inline(rows))


def _altered(raw: Column, new: Column, d) -> Column:
    """Whether the value read from a text is another one than the text says."""
    if d["encoding"] != "array-1d":
        return altered(raw, new, d["encoding"], d["lake_type"])
    dims, lake, pg = element_of(d["lake_type"], d["pg_type"])

    def one(text: Column) -> Column:
        value = encode(text, d["element"], lake, pg)
        return value.isNotNull() & altered(text, value, d["element"], lake)

    flags = array_of(raw, 1, one)  # all dimensions flattened
    return F.coalesce(F.exists(flags, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def altered(raw: Column, new: Column, encoding: str, lake_type: str) -> Column:
    """Compares values and not spellings; ``new`` is the value read from ``raw``.

    Numbers are the same if their significant digits are: reading one keeps its size but
    for rounding, which changes digits. Times are the same if no digits below the
    microsecond, no time of day of a date and no offset of a local time were lost.
    """
    text = F.trim(raw)
    if encoding == "money-decimal":
        return _digits(F.regexp_replace(text, "[^0-9.]", "")) != _digits(new.cast("string"))
    if encoding == "interval-micros" or lake_type.startswith("TIMESTAMP"):
        below = text.rlike(r"[.,]\d{6}\d*[1-9]")
        offset = text.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$") & text.rlike(":")
        return below | offset if lake_type == "TIMESTAMP_NTZ" else below
    if lake_type == "DATE":
        return text.rlike(r"^[+-]?\d+-\d+-\d+[T ].*[1-9]")
    if lake_type.startswith("DECIMAL") or lake_type in _NUMBERS:
        return _digits(text) != _digits(new.cast("string"))
    if encoding == "native" and lake_type == "STRING":
        return raw != new
    # Booleans, bytes, JSON, identifiers and addresses have one value per text they are read from.
    return F.lit(False)


_NUMBERS = ("BYTE", "SHORT", "INTEGER", "INT", "LONG", "BIGINT", "FLOAT", "DOUBLE")


def _digits(number: Column) -> Column:
    """Sign and significant digits of a number as written, or the text where it is none."""
    pattern = r"^([+-]?)0*(\d*)\.?(\d*)(?:[eE][+-]?\d+)?$"
    sign = F.when(number.startswith("-"), "-").otherwise("")
    digits = F.concat(F.regexp_extract(number, pattern, 2), F.regexp_extract(number, pattern, 3))
    kept = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    return F.when(number.rlike(pattern), F.concat(F.when(kept == "", "").otherwise(sign), kept)).otherwise(number)
