"""Operational column types and their lake types, with what a conversion loses."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import local_rows

# Type name, lake type, lossy, encoding, note, type on the way back.
TYPES = (
    ("boolean", "BOOLEAN", False, "native", "", "boolean"),
    ("bool", "BOOLEAN", False, "native", "", "boolean"),
    ("smallint", "SHORT", False, "native", "", "smallint"),
    ("int2", "SHORT", False, "native", "", "smallint"),
    ("integer", "INTEGER", False, "native", "", "integer"),
    ("int", "INTEGER", False, "native", "", "integer"),
    ("int4", "INTEGER", False, "native", "", "integer"),
    ("bigint", "LONG", False, "native", "", "bigint"),
    ("int8", "LONG", False, "native", "", "bigint"),
    ("real", "FLOAT", False, "native", "", "real"),
    ("float4", "FLOAT", False, "native", "", "real"),
    ("double precision", "DOUBLE", False, "native", "", "double precision"),
    ("float8", "DOUBLE", False, "native", "", "double precision"),
    ("text", "STRING", False, "native", "", "text"),
    ("date", "DATE", False, "native", "", "date"),
    ("bytea", "BINARY", False, "native", "", "bytea"),
    ("jsonb", "STRING", True, "json-text",
     "jsonb stored as canonical JSON text; binary jsonb ordering/dedup is not preserved", "jsonb"),
    ("json", "STRING", True, "json-text",
     "json stored as text; whitespace/key-order preserved as-is", "json"),
    ("uuid", "STRING", True, "uuid-text",
     "uuid stored as canonical 36-char text; no native UUID type in Delta", "uuid"),
    ("interval", "LONG", True, "interval-micros",
     "interval stored as total microseconds; month/year components are NOT month-safe and are "
     "flattened using 30-day months", "interval"),
    ("cidr", "STRING", True, "cidr-text",
     "cidr stored as text; netmask validation not enforced by Delta", "cidr"),
    ("inet", "STRING", True, "inet-text", "inet stored as text", "inet"),
    ("macaddr", "STRING", True, "macaddr-text", "macaddr stored as text", "macaddr"),
    ("money", "DECIMAL(19,2)", True, "money-decimal",
     "money mapped to DECIMAL(19,2); locale/currency symbol is dropped", "numeric(19,2)"),
    ("tsvector", "STRING", True, "tsvector-text",
     "full-text search vector flattened to text; lexeme positions lost", "tsvector"),
    ("time", "STRING", True, "time-text", "Delta has no TIME type; stored as ISO time text", "time"),
    ("timetz", "STRING", True, "time-text", "Delta has no TIME type; stored as ISO time text", "time"),
    ("time with time zone", "STRING", True, "time-text",
     "Delta has no TIME type; stored as ISO time text", "time"),
    ("time without time zone", "STRING", True, "time-text",
     "Delta has no TIME type; stored as ISO time text", "time"),
    ("numeric", "DECIMAL(38,18)", True, "decimal-default",
     "unparameterized numeric has arbitrary precision in Postgres; pinned to DECIMAL(38,18)", "numeric"),
    ("decimal", "DECIMAL(38,18)", True, "decimal-default",
     "unparameterized numeric has arbitrary precision in Postgres; pinned to DECIMAL(38,18)", "numeric"),
)
# Type families with parameters.
NUMERIC = r"^(?:numeric|decimal)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)$"
CHARACTER = r"^(?:varchar|character varying|char|character|bpchar)\s*(?:\(\s*\d+\s*\))?$"
CHARACTER_NOTE = "varchar/char length constraint not enforced in Delta STRING"
TIMESTAMP = r"^timestamp(?:\s*\(\d+\))?(?:\s+with(?:out)?\s+time\s+zone)?$"
INSTANT_NOTE = "timestamptz stored as UTC instant; original input offset not retained"
ARRAY_NOTE = (
    "Postgres arrays are multi-dimensional and 1-based; flattened to a 1-D 0-based Delta ARRAY."
)
MAX_PRECISION = 38
# Lake type and its operational type where nothing else is known.
BACK = (
    ("BOOLEAN", "boolean"),
    ("SHORT", "smallint"),
    ("BYTE", "smallint"),
    ("INTEGER", "integer"),
    ("INT", "integer"),
    ("LONG", "bigint"),
    ("BIGINT", "bigint"),
    ("FLOAT", "real"),
    ("DOUBLE", "double precision"),
    ("STRING", "text"),
    ("BINARY", "bytea"),
    ("DATE", "date"),
    ("TIMESTAMP", "timestamp with time zone"),
    ("TIMESTAMP_NTZ", "timestamp without time zone"),
)
BACK_DECIMAL = r"(?i)^DECIMAL\(\s*(\d+)\s*,\s*(\d+)\s*\)$"

# Why a type has no mapping.
EMPTY_TYPE, NO_MAPPING, INVALID_SCALE = "empty_type", "no_mapping", "invalid_scale"

MAPPED = ("lake_type", "lossy", "encoding", "note", "reverse_type", "unmapped")


def normalize_type(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def constant_map(rows: Sequence[tuple], fields: Sequence[str]) -> Column:
    """Rows of constants as a map from their first value to a struct of the others.

    It folds to one literal, so looking up a value is a projection and no join.
    """

    def literal(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    entries = []
    for key, *values in rows:
        named = ", ".join(f"'{f}', {literal(v)}" for f, v in zip(fields, values, strict=True))
        entries.append(f"{literal(key)}, named_struct({named})")
    return F.expr(f"map({', '.join(entries)})")


def _digits(text: Column, pattern: str, group: int) -> Column:
    """The number in a pattern group, as text without leading zeros."""
    return F.regexp_replace(F.regexp_extract(text, pattern, group), r"^0+(?=\d)", "")


def map_types(columns: DataFrame, pg_type: str = "pg_type") -> DataFrame:
    """Add the lake type of every column; ``unmapped`` says why there is none."""
    clean = columns.withColumn("_clean", normalize_type(F.col(pg_type)))
    suffix = r"^(.*?)((?:\s*\[\s*\])*)$"
    parts = clean.withColumns(
        {
            "_base": F.regexp_extract("_clean", suffix, 1),
            "_dims": F.length(F.regexp_replace(F.regexp_extract("_clean", suffix, 2), r"[^\]]", "")),
        }
    )
    known = constant_map(TYPES, ("lake", "lossy", "encoding", "note", "back"))
    parts = parts.withColumn("_known", F.try_element_at(known, F.col("_base")))

    base = F.col("_base")
    named = F.col("_known").isNotNull()
    numeric = base.rlike(NUMERIC)
    p, s = _digits(base, NUMERIC, 1), _digits(base, NUMERIC, 2)
    p_num, s_num = p.try_cast("int"), s.try_cast("int")
    wide = p_num.isNull() | (p_num > MAX_PRECISION)
    bad_scale = numeric & ~wide & (s_num.isNull() | (s_num > p_num))
    character = base.rlike(CHARACTER)
    instant = (base == "timestamptz") | (
        base.startswith("timestamp") & base.contains("with time zone")
    )
    local = base.rlike(TIMESTAMP)

    declared = F.concat(F.lit("numeric("), p, F.lit(","), s, F.lit(")"))
    exact = F.concat(F.lit("DECIMAL("), p, F.lit(","), s, F.lit(")"))
    clamped = F.concat(
        F.lit(f"DECIMAL({MAX_PRECISION},"),
        F.least(F.coalesce(s_num, F.lit(MAX_PRECISION)), F.lit(MAX_PRECISION)).cast("string"),
        F.lit(")"),
    )
    clamp_note = F.concat(
        declared, F.lit(f" exceeds Delta's {MAX_PRECISION}-digit precision; clamped to {MAX_PRECISION}")
    )
    lake = (
        F.when(named, F.col("_known.lake"))
        .when(bad_scale, F.lit(None))
        .when(numeric, F.when(wide, clamped).otherwise(exact))
        .when(character, "STRING")
        .when(instant, "TIMESTAMP")
        .when(local, "TIMESTAMP_NTZ")
    )
    lossy = F.when(named, F.col("_known.lossy")).otherwise(numeric & wide)
    encoding = (
        F.when(named, F.col("_known.encoding"))
        .when(numeric & wide, "decimal-clamped")
        .when(instant, "utc-instant")
        .otherwise("native")
    )
    note = (
        F.when(named, F.col("_known.note"))
        .when(numeric & wide, clamp_note)
        .when(character, CHARACTER_NOTE)
        .when(instant, INSTANT_NOTE)
        .otherwise("")
    )
    back = (
        F.when(named, F.col("_known.back"))
        .when(numeric, declared)
        .when(character, "text")
        .when(instant, "timestamp with time zone")
        .when(local, "timestamp without time zone")
    )
    unmapped = (
        F.when(base.isNull() | (base == ""), EMPTY_TYPE).when(bad_scale, INVALID_SCALE).when(lake.isNull(), NO_MAPPING)
    )
    dims, is_array = F.col("_dims"), F.col("_dims") > 0
    ok = unmapped.isNull()
    result = {
        "lake_type": F.concat(F.repeat(F.lit("ARRAY<"), dims), lake, F.repeat(F.lit(">"), dims)),
        "lossy": F.when(ok, is_array | lossy),
        "encoding": F.when(ok, F.when(is_array, "array-1d").otherwise(encoding)),
        "note": F.when(ok, F.trim(F.concat(F.repeat(F.lit(ARRAY_NOTE + " "), dims), note))),
        "reverse_type": F.when(ok, F.concat(back, F.repeat(F.lit("[]"), dims))),
        "unmapped": unmapped,
    }
    return parts.select(*columns.columns, *[c.alias(n) for n, c in result.items()])


def map_types_back(columns: DataFrame, lake_type: str = "lake_type") -> DataFrame:
    """Add ``pg_type`` for lake types that come without a known encoding."""
    text = F.trim(F.col(lake_type))
    opening = F.regexp_extract(text, r"(?i)^((?:ARRAY<\s*)*)", 1)
    dims = F.length(F.regexp_replace(opening, "[^<]", ""))
    body = F.expr(f"substring(trim({lake_type}), length(_opening) + 1)")
    closing = F.concat(F.lit(r"^(.+?)(?:\s*>){"), F.col("_dims").cast("string"), F.lit("}$"))
    parts = columns.withColumns({"_opening": opening, "_dims": dims})
    element = F.trim(F.call_function("regexp_extract", body, closing, F.lit(1)))
    parts = parts.withColumn("_base", F.when(F.col("_dims") == 0, text).otherwise(element))
    base = F.col("_base")
    known = F.try_element_at(constant_map(BACK, ("back",)), F.upper(base))["back"]
    decimal = F.concat(
        F.lit("numeric("), F.regexp_extract(base, BACK_DECIMAL, 1),
        F.lit(","), F.regexp_extract(base, BACK_DECIMAL, 2), F.lit(")"),
    )
    pg = (
        F.when(known.isNotNull(), known)
        .when(base.rlike(BACK_DECIMAL), decimal)
        .when(F.upper(base).rlike("^(MAP|STRUCT)<"), "jsonb")
    )
    result = F.concat(pg, F.repeat(F.lit("[]"), F.col("_dims")))
    return parts.select(
        *columns.columns,
        result.alias("pg_type"),
        F.when(result.isNull(), NO_MAPPING).alias("unmapped"),
    )


def declare(spark: SparkSession, columns: Sequence[tuple[str, str]]) -> list:
    """The mapping of the declared columns of one table, in order.

    One table has at most 1,600 columns, so this is small wherever it runs.
    """
    rows = [(i, name, pg_type) for i, (name, pg_type) in enumerate(columns)]
    # The same types without dimensions say how elements are coded.
    rows += [(-1 - i, name, re.sub(r"(\s*\[\s*\])+\s*$", "", pg_type)) for i, name, pg_type in rows]
    mapped = map_types(local_rows(spark, rows, "position INT, name STRING, pg_type STRING")).collect()
    element = {-1 - r["position"]: r["encoding"] for r in mapped if r["position"] < 0}
    found = sorted((r for r in mapped if r["position"] >= 0), key=lambda r: r["position"])
    bad = [f"{r['name']} ({r['pg_type']}): {r['unmapped']}" for r in found if r["unmapped"]]
    if bad:
        raise ValueError("no lake type for " + ", ".join(bad))
    return [r.asDict() | {"element": element[r["position"]]} for r in found]
