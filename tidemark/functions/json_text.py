"""JSON text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a change message that describe the change and are not table data.
META_PREFIX = "__"


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every level and no spaces; null if invalid."""
    return F.to_json(F.try_parse_json(text))


def json_or_text(text: Column) -> Column:
    """Objects and arrays become canonical JSON; any other text stays as it is."""
    nested = F.ltrim(text).rlike(r"^[\{\[]")
    return F.when(nested, F.coalesce(canonical_json(text), text)).otherwise(text)


def has_data_field(text: Column) -> Column:
    """True if a JSON object has a field that is table data, null if no object."""
    return F.exists(F.json_object_keys(text), is_data_field)


def is_data_field(name: Column) -> Column:
    return ~F.startswith(name, F.lit(META_PREFIX))
