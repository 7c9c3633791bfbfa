"""Raw text of operational values as lake values, and intervals back again.

Every function gives null for text it cannot read, so that a cast can be counted
(``typed.cast_report``) and never fails a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.json_text import canonical_json

DAY = 86_400_000_000
# Intervals in the database's own text form and in ISO form.
VERBOSE = (
    r"^(?=.)(?:([-+]?\d+) years? ?)?(?:([-+]?\d+) mons? ?)?(?:([-+]?\d+) days? ?)?"
    r"(?:([-+]?)(\d+):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?$"
)
ISO = (
    r"^P(?=.)(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)D)?"
    r"(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?)(\d+)(?:\.(\d{1,6}))?S)?)?$"
)
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?([+-]\d{2}(:?\d{2})?)?$"
UUID = r"^\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"
ARRAY_PART = r'(?s)"(?:[^"\\]|\\.)*"|[{},]|[^{},"]+'
#: Dimensions of the database's arrays.
MAX_DIMS = 6
EPOCH_UNITS = {"seconds": 1_000_000, "millis": 1_000, "micros": 1}


def _number(text: Column, pattern: str, group: int) -> Column:
    """A number of the text: 0 if it has none, null if it is too large."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", F.lit(0).cast("bigint")).otherwise(found.try_cast("bigint"))


def _sum_of(*parts: tuple[Column, int]) -> Column:
    """The sum of numbers times units, null if it is too large."""
    total = F.lit(0).cast("bigint")
    for number, unit in parts:
        total = F.try_add(total, F.try_multiply(number, F.lit(unit).cast("bigint")))
    return total


def _fraction(text: Column, pattern: str, group: int) -> Column:
    return F.rpad(F.regexp_extract(text, pattern, group), 6, "0").try_cast("bigint")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def interval_micros(text: Column) -> Column:
    """Total microseconds, a month being 30 days. Whole numbers are microseconds."""
    return bind(F.trim(text), _interval_micros)


def _interval_micros(t: Column) -> Column:
    low, up = F.lower(t), F.upper(t)
    clock = _sum_of(
        (_number(low, VERBOSE, 5), 3_600_000_000),
        (_number(low, VERBOSE, 6), 60_000_000),
        (_number(low, VERBOSE, 7), 1_000_000),
        (F.coalesce(_fraction(low, VERBOSE, 8), F.lit(0)), 1),
    )
    sign = F.when(F.regexp_extract(low, VERBOSE, 4) == "-", -1).otherwise(1)
    days = ((_number(low, VERBOSE, 1), 360 * DAY), (_number(low, VERBOSE, 2), 30 * DAY), (_number(low, VERBOSE, 3), DAY))
    verbose = F.try_add(_sum_of(*days), sign * clock)

    iso_sign = F.when(F.regexp_extract(up, ISO, 6) == "-", -1).otherwise(1)
    seconds = _sum_of((_number(up, ISO, 7), 1_000_000), (F.coalesce(_fraction(up, ISO, 8), F.lit(0)), 1))
    iso = _sum_of(
        (_number(up, ISO, 1), 360 * DAY),
        (_number(up, ISO, 2), 30 * DAY),
        (_number(up, ISO, 3), DAY),
        (_number(up, ISO, 4), 3_600_000_000),
        (_number(up, ISO, 5), 60_000_000),
        (iso_sign * seconds, 1),
    )
    return (
        F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint"))
        .when(low.rlike(VERBOSE), verbose)
        .when(up.rlike(ISO), iso)
    )


def interval_text(micros: Column) -> Column:
    """Microseconds as text the database reads as the same interval."""
    return F.when(micros.isNotNull(), bind(micros.cast("bigint"), _interval_text))


def _interval_text(micros: Column) -> Column:
    def part(unit: int, wrap: int | None) -> Column:
        whole = F.call_function("div", F.abs(micros), F.lit(unit).cast("bigint"))
        text = (whole % wrap if wrap else whole).cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))

    sign = F.when(micros < 0, "-").otherwise("")
    fraction = F.lpad((F.abs(micros) % 1_000_000).cast("string"), 6, "0")
    clock = F.concat_ws(":", part(3_600_000_000, None), part(60_000_000, 60), part(1_000_000, 60))
    return F.concat(sign, clock, F.lit("."), fraction)


def money_decimal(text: Column) -> Column:
    """The amount without symbol and grouping; parentheses or a minus negate."""
    t = F.trim(text)
    negative = t.rlike(r"^\(.*\)$") | t.rlike(r"^[^0-9]*-")
    digits = F.regexp_replace(t, r"[^0-9.]", "")
    readable = t.rlike(r"^[-(]*\s*[^0-9A-Za-z]*[0-9][0-9,]*(\.[0-9]+)?\)?$")
    amount = F.when(readable, digits.try_cast("decimal(19,2)"))
    return F.when(negative, -amount).otherwise(amount).cast("decimal(19,2)")


def uuid_text(text: Column) -> Column:
    """The 36-character lower-case form; braces and missing hyphens are accepted."""
    t = F.lower(F.trim(text))
    groups = [F.regexp_extract(t, UUID, i) for i in range(1, 6)]
    return F.when(t.rlike(UUID), F.concat_ws("-", *groups))


def time_text(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(CLOCK), t)


def instant(text: Column, epoch_unit: str | None = None) -> Column:
    """A UTC instant from text with or without an offset, or from epoch numbers."""
    if epoch_unit is None:
        return F.trim(text).try_cast("timestamp")
    return F.timestamp_micros(text.try_cast("bigint") * EPOCH_UNITS[epoch_unit])


def array_json(text: Column) -> Column:
    """An array as JSON text: JSON as it is, the database's ``{...}`` form with its elements as JSON strings."""
    t = F.trim(text)
    tokens = F.regexp_extract_all(t, F.lit(ARRAY_PART), F.lit(0))

    def quoted(inner: Column) -> Column:
        escaped = F.regexp_replace(inner, r'([\\\\"])', r"\\$1")
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    def part(token: Column) -> Column:
        bare = F.trim(token)
        inner = F.regexp_replace(F.substring(bare, F.lit(2), F.length(bare) - 2), r"(?s)\\(.)", "$1")
        return (
            F.when(bare == "{", "[").when(bare == "}", "]").when(bare == ",", ",").when(bare == "", "")
            .when(F.upper(bare) == "NULL", "null")
            .when(bare.startswith('"'), quoted(inner))
            .otherwise(quoted(bare))
        )

    literal = F.array_join(F.transform(tokens, part), "")
    return F.when(t.startswith("["), t).when(t.rlike(r"(?s)^\{.*\}$"), literal)


def array_of(text: Column, dims: int, element: Callable[[Column], Column]) -> Column:
    """An array of so many dimensions, each element coded from its own text.

    The text may have up to ``MAX_DIMS`` dimensions: inner ones more than declared are
    flattened, and missing ones are wrapped, so that no element is lost.
    """
    def coded(json: Column) -> Column:
        depth = F.length(F.regexp_replace(F.regexp_extract(json, r"^(?:\s*\[)+", 0), r"[^\[]", ""))
        out = None
        for k in range(1, MAX_DIMS + 1):
            found = F.from_json(json, "array<" * k + "string" + ">" * k, {"allowUnquotedControlChars": "true"})
            for _ in range(k - dims):
                found = _inside(found, dims - 1, F.flatten)
            found = _inside(found, min(k, dims), element)
            for _ in range(dims - k):
                found = F.when(found.isNotNull(), F.array(found))
            out = F.when(depth == k, found) if out is None else out.when(depth == k, found)
        return out

    return bind(array_json(text), coded)


def _inside(value: Column, levels: int, work: Callable[[Column], Column]) -> Column:
    return F.transform(value, lambda x: _inside(x, levels - 1, work)) if levels else work(value)


def element_of(lake_type: str, pg_type: str) -> tuple[int, str, str]:
    """The dimensions of an array type, and both types of its elements."""
    dims = lake_type.count("ARRAY<")
    return dims, lake_type[len("ARRAY<") * dims : len(lake_type) - dims], re.sub(r"[\s\[\]]+$", "", pg_type)


def array_1d(text: Column, element: str) -> Column:
    """A flat array from JSON or from the database's ``{...}`` form, elements being cast.

    Inner dimensions are flattened; an unquoted NULL is a missing element.
    """
    return array_of(text, 1, lambda x: x.try_cast(element))


def encode(
    text: Column,
    encoding: str,
    lake_type: str,
    pg_type: str = "",
    epoch_unit: str | None = None,
    element: str = "native",
) -> Column:
    """The lake value of a raw text under the encoding its type is mapped with.

    ``element`` is the encoding of an array's elements.
    """
    if encoding == "json-text":
        # json keeps its text, jsonb has one canonical form.
        return F.when(canonical_json(text).isNotNull(), text) if pg_type == "json" else canonical_json(text)
    if encoding == "uuid-text":
        return uuid_text(text)
    if encoding == "interval-micros":
        return interval_micros(text)
    if encoding == "money-decimal":
        return money_decimal(text)
    if encoding == "utc-instant":
        return instant(text, epoch_unit)
    if encoding == "time-text":
        return time_text(text)
    if encoding == "array-1d":
        dims, lake, pg = element_of(lake_type, pg_type)
        return array_of(text, dims, lambda x: encode(x, element, lake, pg, epoch_unit))
    if encoding in ("cidr-text", "inet-text", "macaddr-text", "tsvector-text"):
        return F.trim(text)
    if encoding in ("decimal-clamped", "decimal-default"):
        return F.trim(text).try_cast(lake_type)
    if encoding != "native":
        raise ValueError(f"unknown encoding {encoding!r}")
    if lake_type == "STRING":
        return text
    if lake_type == "BINARY":
        in_hex = F.try_to_binary(F.substring(F.trim(text), 3, 2**31 - 1), F.lit("hex"))
        return F.when(F.trim(text).startswith("\\x"), in_hex).otherwise(F.try_to_binary(text, F.lit("base64")))
    if lake_type == "TIMESTAMP_NTZ" and epoch_unit:
        return instant(text, epoch_unit).cast("timestamp_ntz")
    if lake_type == "DATE" and epoch_unit:
        return F.date_from_unix_date(text.try_cast("int"))
    return F.trim(text).try_cast(lake_type)
