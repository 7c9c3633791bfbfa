"""Queries over column catalogues, types and values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import encode as en
from tidemark.functions import type_map as tm
from tidemark.operators import catalog, envelope, typed
from tidemark.plans import fixtures as fx
from tidemark.plans.feed_queries import MESSAGES_SQL

WIDE = [("user_id", "bigint"), ("value", "numeric(10,2)"), ("props", "jsonb"), ("extra", "varchar(10)")]
NARROW = [("user_id", "smallint"), ("value", "numeric(3,1)"), ("props", "json"), ("extra", "integer")]


def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.column_catalog(**fx.database_catalog(spark, sf_dir))


def map_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.map_types(fx.catalog_rows(spark, sf_dir)).drop("nullable")


def _lake_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lake types of the catalogue, and some no operational type maps to."""
    mapped = tm.map_types(fx.column_rows(spark, sf_dir))
    key = F.col("p_partkey")
    foreign = (
        F.when(key % 9 == 0, F.concat(F.lit("map<string,"), F.coalesce("lake_type", F.lit("int")), F.lit(">")))
        .when(key % 9 == 1, " Array< Struct<a:INT> > ")
        .when(key % 9 == 2, "geometry")
        .when(key % 9 == 3, "decimal( 9 , 3 )")
        .otherwise(F.col("lake_type"))
    )
    return mapped.select("p_partkey", foreign.alias("lake_type")).filter(F.col("lake_type").isNotNull())


def map_types_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.map_types_back(_lake_types(spark, sf_dir))


def roundtrip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = tm.map_types(fx.catalog_rows(spark, sf_dir)).filter(F.col("unmapped").isNull())
    return mapped.select("table", "name", "pg_type", F.col("reverse_type").alias("back"), "lossy")


def encode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, encoding = F.col("raw"), F.col("encoding")
    lake = {
        "interval-micros": "LONG", "money-decimal": "DECIMAL(19,2)", "uuid-text": "STRING",
        "json-text": "STRING", "decimal-clamped": "DECIMAL(38,5)", "decimal-default": "DECIMAL(38,18)",
        "utc-instant": "TIMESTAMP", "time-text": "STRING", "array-1d": "ARRAY<LONG>",
    }
    stored = F.lit(None).cast("string")
    for name, lake_type in lake.items():
        value = en.encode(raw, name, lake_type)
        if name == "utc-instant":
            value = F.unix_micros(value)
        text = F.to_json(value) if name == "array-1d" else value.cast("string")
        stored = F.when(encoding == name, text).otherwise(stored)
    return fx.raw_values(spark, sf_dir).select("o_orderkey", "encoding", "raw", stored.alias("stored"))


def _nested(rows: Column, work) -> Column:
    return F.transform(rows, lambda row: F.transform(row, work))


def encode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts as elements: each in a database literal of two dimensions, in JSON, and next to a missing one."""
    raw, encoding, even = F.col("raw"), F.col("encoding"), F.col("o_orderkey") % 2 == 0
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(raw, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    literal = F.concat(F.lit("{{"), quoted, F.lit(",NULL},{null,"), quoted, F.lit("}}"))
    text = F.when(even, literal).otherwise(F.concat(F.lit("["), quoted, F.lit(",null]")))
    rows = fx.raw_values(spark, sf_dir).filter(encoding != "array-1d").withColumn("text", text)
    lake = {
        "interval-micros": "LONG", "money-decimal": "DECIMAL(19,2)", "uuid-text": "STRING",
        "json-text": "STRING", "decimal-clamped": "DECIMAL(38,5)", "decimal-default": "DECIMAL(38,18)",
        "utc-instant": "TIMESTAMP", "time-text": "STRING",
    }
    flat, nested = F.lit(None).cast("string"), F.lit(None).cast("string")

    def shown(name: str):
        return lambda x: (F.unix_micros(x) if name == "utc-instant" else x).cast("string")

    for name, lake_type in lake.items():
        one = en.encode(F.col("text"), "array-1d", f"ARRAY<{lake_type}>", element=name)
        two = en.encode(F.col("text"), "array-1d", f"ARRAY<ARRAY<{lake_type}>>", element=name)
        flat = F.when(encoding == name, F.to_json(F.transform(one, shown(name)))).otherwise(flat)
        both = _nested(two, shown(name))
        nested = F.when(encoding == name, F.to_json(both)).otherwise(nested)
    return rows.select("o_orderkey", "encoding", flat.alias("flat"), nested.alias("nested"))


def decode_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as the database reads them back."""
    values = fx.raw_values(spark, sf_dir).filter(F.col("encoding") == "interval-micros")
    parsed = values.withColumn("us", en.interval_micros(F.col("raw")))
    shown = parsed.withColumn("interval", en.interval_text(F.col("us")))
    same = en.interval_micros(F.col("interval")) == F.col("us")
    return shown.select("o_orderkey", "interval", same.alias("same"))


def catalog_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.descriptors(fx.catalog_rows(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return catalog.schema_drift(fx.catalog_rows(spark, sf_dir), fx.registered_rows(spark, sf_dir), **options)


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.only_drift(_compared(spark, sf_dir)).drop("position")


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = catalog.drift_summary(_compared(spark, sf_dir))
    moved = F.transform("type_changed", lambda c: F.concat(c["column"], F.lit(":"), c["from"], F.lit(">"), c["to"]))
    return summary.select(
        "table", "in_sync",
        F.array_join("added", ";").alias("added"),
        F.array_join("removed", ";").alias("removed"),
        F.array_join(moved, ";").alias("type_changed"),
        F.array_join("unmapped", ";").alias("unmapped"),
    )


def schema_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_states(_compared(spark, sf_dir))


def schema_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table in drift is written again, with all its columns that have a type."""
    return catalog.reconcile(fx.catalog_rows(spark, sf_dir), fx.registered_rows(spark, sf_dir), partial=True)


def lossy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = catalog.lossy_report(fx.catalog_rows(spark, sf_dir))
    text = F.transform(
        "lossy_columns", lambda c: F.concat_ws("|", c["column"], c["pg_type"], c["lake_type"], c["note"])
    )
    return report.select("table", "n_lossy", F.array_join(text, ";").alias("lossy_columns"))


def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_history(fx.catalog_snapshots(spark, sf_dir))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.feed_rows(fx.messages(spark, sf_dir))


def typed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.typed_feed(_feed(spark, sf_dir), WIDE)
    return rows.select("project", "offset", *[n for n, _ in WIDE], F.col("_op").alias("op"))


def cast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.cast_report(_feed(spark, sf_dir), NARROW)


QUERIES = {
    "column_catalog": column_catalog,
    "map_types": map_types,
    "map_types_reverse": map_types_reverse,
    "roundtrip_types": roundtrip_types,
    "encode_values": encode_values,
    "encode_arrays": encode_arrays,
    "decode_intervals": decode_intervals,
    "catalog_descriptor": catalog_descriptor,
    "schema_drift": schema_drift,
    "drift_summary": drift_summary,
    "schema_state": schema_state,
    "schema_reconcile": schema_reconcile,
    "lossy_report": lossy_report,
    "schema_history": schema_history,
    "typed_feed": typed_feed,
    "cast_report": cast_report,
}


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


# What is noted of a conversion, by type or family of types.
NOTES = {
    "jsonb": "jsonb stored as canonical JSON text; binary jsonb ordering/dedup is not preserved",
    "json": "json stored as text; whitespace/key-order preserved as-is",
    "uuid": "uuid stored as canonical 36-char text; no native UUID type in Delta",
    "cidr": "cidr stored as text; netmask validation not enforced by Delta",
    "inet": "inet stored as text",
    "macaddr": "macaddr stored as text",
    "tsvector": "full-text search vector flattened to text; lexeme positions lost",
    "time": "Delta has no TIME type; stored as ISO time text",
    "numeric": "unparameterized numeric has arbitrary precision in Postgres; pinned to DECIMAL(38,18)",
    "interval": "interval stored as total microseconds; month/year components are NOT month-safe and are flattened using 30-day months",
    "money": "money mapped to DECIMAL(19,2); locale/currency symbol is dropped",
    "character": "varchar/char length constraint not enforced in Delta STRING",
    "instant": "timestamptz stored as UTC instant; original input offset not retained",
    "array": "Postgres arrays are multi-dimensional and 1-based; flattened to a 1-D 0-based Delta ARRAY.",
}


def _expected() -> list[tuple]:
    """What each type of fixture E maps to, written out by hand."""
    same = [
        ("boolean", "BOOLEAN", "boolean"), ("bool", "BOOLEAN", "boolean"), ("smallint", "SHORT", "smallint"),
        ("int2", "SHORT", "smallint"), ("integer", "INTEGER", "integer"), ("int", "INTEGER", "integer"),
        ("int4", "INTEGER", "integer"), ("bigint", "LONG", "bigint"), ("int8", "LONG", "bigint"),
        ("real", "FLOAT", "real"), ("float4", "FLOAT", "real"), ("double precision", "DOUBLE", "double precision"),
        ("float8", "DOUBLE", "double precision"), ("text", "STRING", "text"), ("date", "DATE", "date"),
        ("bytea", "BINARY", "bytea"), ("numeric(10,2)", "DECIMAL(10,2)", "numeric(10,2)"),
        ("decimal ( 12 , 4 )", "DECIMAL(12,4)", "numeric(12,4)"), ("numeric(38,0)", "DECIMAL(38,0)", "numeric(38,0)"),
        ("timestamp", "TIMESTAMP_NTZ", "timestamp without time zone"),
        ("timestamp (6)", "TIMESTAMP_NTZ", "timestamp without time zone"),
        ("timestamp without time zone", "TIMESTAMP_NTZ", "timestamp without time zone"),
        ("  Double   Precision ", "DOUBLE", "double precision"),
    ]
    rows = [(t, lake, False, "native", "", back, None) for t, lake, back in same]
    rows += [
        (t, "STRING", True, "json-text" if t.startswith("json") else f"{t}-text", NOTES[t], t, None)
        for t in ("jsonb", "json", "uuid", "cidr", "inet", "macaddr", "tsvector")
    ]
    rows += [(t, "STRING", False, "native", NOTES["character"], "text", None)
             for t in ("varchar(255)", "character varying", "char(3)", "bpchar")]
    rows += [(t, "TIMESTAMP", False, "utc-instant", NOTES["instant"], "timestamp with time zone", None)
             for t in ("timestamptz", "timestamp with time zone", "timestamp(3) with time zone")]
    rows += [(t, "STRING", True, "time-text", NOTES["time"], "time", None)
             for t in ("time", "timetz", "time with time zone", "time without time zone")]
    rows += [(t, "DECIMAL(38,18)", True, "decimal-default", NOTES["numeric"], "numeric", None)
             for t in ("numeric", "decimal")]
    clamp = "numeric({}) exceeds Delta's 38-digit precision; clamped to 38"
    a = NOTES["array"]
    rows += [
        ("interval", "LONG", True, "interval-micros", NOTES["interval"], "interval", None),
        ("money", "DECIMAL(19,2)", True, "money-decimal", NOTES["money"], "numeric(19,2)", None),
        ("numeric(40,5)", "DECIMAL(38,5)", True, "decimal-clamped", clamp.format("40,5"), "numeric(40,5)", None),
        ("numeric(50,45)", "DECIMAL(38,38)", True, "decimal-clamped", clamp.format("50,45"), "numeric(50,45)", None),
        ("integer[]", "ARRAY<INTEGER>", True, "array-1d", a, "integer[]", None),
        ("uuid[]", "ARRAY<STRING>", True, "array-1d", f"{a} {NOTES['uuid']}", "uuid[]", None),
        ("integer[][]", "ARRAY<ARRAY<INTEGER>>", True, "array-1d", f"{a} {a}", "integer[][]", None),
        ("varchar(5) [ ]", "ARRAY<STRING>", True, "array-1d", f"{a} {NOTES['character']}", "text[]", None),
        ("numeric(40,5)[]", "ARRAY<DECIMAL(38,5)>", True, "array-1d", f"{a} {clamp.format('40,5')}", "numeric(40,5)[]", None),
    ]
    none = (None, None, None, None, None)
    rows += [(t, *none, "no_mapping") for t in ("numeric(5)", "time(3)", "timestamptz(3)", "some_custom_enum", "some_custom_enum[]")]
    rows += [("numeric(5,7)", *none, "invalid_scale"), ("", *none, "empty_type"), ("[]", *none, "empty_type")]
    return rows


def _expected_sql() -> str:
    rows = [
        f"({_text(t)}, {_text(lake)}, {'NULL' if lossy is None else lossy}, {_text(enc)}, {_text(n)}, {_text(back)}, {_text(why)})"
        for t, lake, lossy, enc, n, back, why in _expected()
    ]
    return ", ".join(rows)


_TYPE_LIST = "[" + ", ".join(_text(t) for t in fx.PG_TYPES) + "]"
CATALOG_SQL = f"""
WITH m(pg_type, lake_type, lossy, encoding, note, reverse_type, unmapped) AS (VALUES {_expected_sql()}),
col AS (
  SELECT p_partkey, 't' || (p_partkey // 20) AS tbl, CAST(p_partkey % 20 AS INTEGER) AS position,
         'c' || (p_partkey % 20) AS name, {_TYPE_LIST}[p_partkey % {len(fx.PG_TYPES)} + 1] AS pg_type,
         p_size % 2 = 0 AS nullable
  FROM part),
mc AS (SELECT col.*, m.* EXCLUDE (pg_type) FROM col JOIN m USING (pg_type))
"""
# Descriptor fields of the catalogue's columns.
DESCRIBED_SQL = CATALOG_SQL + """
, kinds AS (
  SELECT *, regexp_replace(lake_type, '^(ARRAY<)+|>+$', '', 'g') AS b,
         length(lake_type) - length(replace(lake_type, '>', '')) AS dims
  FROM mc WHERE unmapped IS NULL),
des AS (
  SELECT tbl, position, name, nullable, lower(lake_type) AS type_text,
         CASE WHEN dims > 0 THEN 'ARRAY' WHEN b LIKE 'DECIMAL%' THEN 'DECIMAL' WHEN b = 'INTEGER' THEN 'INT' ELSE b END AS type_name,
         '{"name":"' || name || '","type":' || repeat('{"type":"array","elementType":', dims) || '"' || lower(b) || '"'
           || repeat(',"containsNull":true}', dims) || ',"nullable":' || nullable || ',"metadata":{}}' AS type_json,
         CASE WHEN dims = 0 AND b LIKE 'DECIMAL%' THEN CAST(regexp_extract(b, '\\((\\d+),', 1) AS INTEGER) END AS type_precision,
         CASE WHEN dims = 0 AND b LIKE 'DECIMAL%' THEN CAST(regexp_extract(b, ',(\\d+)\\)', 1) AS INTEGER) END AS type_scale
  FROM kinds)
"""
DRIFT_SQL = CATALOG_SQL + """
, reg0 AS (
  SELECT tbl, name, CASE WHEN p_partkey % 11 = 0 THEN 'STRING' ELSE lake_type END AS t, p_partkey FROM mc
  WHERE unmapped IS NULL AND p_partkey % 7 <> 0),
reg AS (
  SELECT tbl, name, CASE WHEN p_partkey % 2 = 0 THEN lower(t) ELSE t END AS registered FROM reg0
  UNION ALL SELECT tbl, 'legacy_' || position, 'STRING' FROM col WHERE p_partkey % 13 = 0),
cmp AS (
  SELECT coalesce(m.tbl, r.tbl) AS tbl, coalesce(m.name, r.name) AS name, r.registered AS from_type, m.lake_type AS to_type,
         CASE WHEN m.tbl IS NULL THEN 'removed' WHEN m.unmapped IS NOT NULL THEN 'unmapped'
              WHEN r.tbl IS NULL THEN 'added' WHEN upper(m.lake_type) <> upper(r.registered) THEN 'type_changed' END AS change
  FROM mc m FULL OUTER JOIN reg r ON m.tbl = r.tbl AND m.name = r.name)
"""

ORACLE = {
    "column_catalog": CATALOG_SQL + """
SELECT 'proj_p' || (p_partkey // 20 % 3) AS schema, tbl AS "table", position + 1 AS position, name, pg_type, nullable,
       position = 0 OR (position = 1 AND p_partkey // 20 % 2 = 1) AS is_key
FROM col WHERE position <> 19
""",
    "map_types": CATALOG_SQL + """
SELECT tbl AS "table", position, name, pg_type, lake_type, lossy, encoding, note, reverse_type, unmapped FROM mc
""",
    "map_types_reverse": CATALOG_SQL + """
, f AS (
  SELECT p_partkey, p_partkey % 9 AS k, lake_type FROM mc),
t AS (
  SELECT p_partkey, k, CASE k WHEN 0 THEN 'map<string,' || coalesce(lake_type, 'int') || '>'
                     WHEN 1 THEN ' Array< Struct<a:INT> > ' WHEN 2 THEN 'geometry' WHEN 3 THEN 'decimal( 9 , 3 )'
                     ELSE lake_type END AS lake_type FROM f),
b AS (
  SELECT *, regexp_replace(lake_type, '^(ARRAY<)+|>+$', '', 'g') AS b, length(lake_type) - length(replace(lake_type, '>', '')) AS dims
  FROM t WHERE lake_type IS NOT NULL)
SELECT p_partkey, lake_type,
       CASE k WHEN 0 THEN 'jsonb' WHEN 1 THEN 'jsonb[]' WHEN 2 THEN NULL WHEN 3 THEN 'numeric(9,3)'
         ELSE CASE b WHEN 'BOOLEAN' THEN 'boolean' WHEN 'SHORT' THEN 'smallint' WHEN 'INTEGER' THEN 'integer'
                     WHEN 'LONG' THEN 'bigint' WHEN 'FLOAT' THEN 'real' WHEN 'DOUBLE' THEN 'double precision'
                     WHEN 'STRING' THEN 'text' WHEN 'BINARY' THEN 'bytea' WHEN 'DATE' THEN 'date'
                     WHEN 'TIMESTAMP' THEN 'timestamp with time zone' WHEN 'TIMESTAMP_NTZ' THEN 'timestamp without time zone'
                     ELSE replace(b, 'DECIMAL', 'numeric') END || repeat('[]', dims) END AS pg_type,
       CASE WHEN k = 2 THEN 'no_mapping' END AS unmapped
FROM b
""",
    "roundtrip_types": CATALOG_SQL + """
SELECT tbl AS "table", name, pg_type, reverse_type AS back, lossy FROM mc WHERE unmapped IS NULL
""",
    "encode_values": """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 20 AS kind, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         md5(CAST(o_orderkey AS VARCHAR)) AS h
  FROM orders),
p AS (
  SELECT *, lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') || ':'
              || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS clock,
         ((k % 24) * 3600 + (c % 60) * 60 + k % 60) * 1000000 AS clock_us,
         h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id,
         '$' || (cents // 100000) || ',' || lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0') || '.'
              || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS money,
         CAST(k AS VARCHAR) || repeat('7', CAST(k % 40 AS INTEGER)) AS big
  FROM o)
SELECT k AS o_orderkey,
  CASE WHEN kind IN (0, 1, 2, 12) THEN 'interval-micros' WHEN kind IN (3, 4, 13) THEN 'money-decimal'
       WHEN kind IN (5, 14) THEN 'uuid-text' WHEN kind IN (6, 15) THEN 'json-text'
       WHEN kind IN (7, 16) THEN 'decimal-clamped' WHEN kind = 8 THEN 'decimal-default'
       WHEN kind IN (9, 17) THEN 'utc-instant' WHEN kind IN (10, 18) THEN 'time-text' ELSE 'array-1d' END AS encoding,
  CASE kind WHEN 0 THEN (k % 5) || ' years ' || (k % 12) || ' mons ' || (k % 40) || ' days ' || clock || '.5'
    WHEN 1 THEN '-' || clock
    WHEN 2 THEN 'P' || (k % 40) || 'DT' || (k % 24) || 'H' || (k % 60) || '.25S'
    WHEN 3 THEN money WHEN 4 THEN '(' || money || ')' WHEN 5 THEN '{' || upper(id) || '}'
    WHEN 6 THEN '{"b": ' || k || ', "a": [' || c || ']}' WHEN 7 THEN big || '.125'
    WHEN 8 THEN c || '.1234567890123456789' WHEN 9 THEN '2001-02-03 ' || clock || '+02'
    WHEN 10 THEN ' ' || clock || '.25' WHEN 11 THEN '{{' || k || ',' || c || '},{NULL,7}}'
    WHEN 12 THEN 'soon' WHEN 13 THEN 'n/a' WHEN 14 THEN '1234' WHEN 15 THEN '{"b": ' || k
    WHEN 16 THEN 'abc' WHEN 17 THEN 'yesterday' WHEN 18 THEN '25:00' ELSE '1,2' END AS raw,
  CASE kind WHEN 0 THEN CAST((((k % 5) * 12 + k % 12) * 30 + k % 40) * 86400000000 + clock_us + 500000 AS VARCHAR)
    WHEN 1 THEN CAST(-clock_us AS VARCHAR)
    WHEN 2 THEN CAST((k % 40) * 86400000000 + (k % 24) * 3600000000 + (k % 60) * 1000000 + 250000 AS VARCHAR)
    WHEN 3 THEN CAST(CAST(cents AS DECIMAL(19,0)) / 100 AS DECIMAL(19,2))::VARCHAR
    WHEN 4 THEN (-CAST(CAST(cents AS DECIMAL(19,0)) / 100 AS DECIMAL(19,2)))::VARCHAR
    WHEN 5 THEN id WHEN 6 THEN '{"a":[' || c || '],"b":' || k || '}'
    WHEN 7 THEN CASE WHEN length(ltrim(big, '0')) <= 33 THEN CASE WHEN ltrim(big, '0') = '' THEN '0' ELSE ltrim(big, '0') END || '.12500' END
    WHEN 8 THEN c || '.123456789012345679'
    WHEN 9 THEN CAST(epoch_us(TIMESTAMP '2001-02-03 00:00:00') + clock_us - 7200000000 AS VARCHAR)
    WHEN 10 THEN clock || '.25' WHEN 11 THEN '[' || k || ',' || c || ',null,7]' END AS stored
FROM p
""",
    "decode_intervals": """
WITH o AS (
  SELECT o_orderkey AS k, o_orderkey % 20 AS kind, o_custkey AS c FROM orders WHERE o_orderkey % 20 IN (0, 1, 2, 12)),
u AS (
  SELECT k, CASE kind
    WHEN 0 THEN (((k % 5) * 12 + k % 12) * 30 + k % 40) * 86400000000 + ((k % 24) * 3600 + (c % 60) * 60 + k % 60) * 1000000 + 500000
    WHEN 1 THEN -((k % 24) * 3600 + (c % 60) * 60 + k % 60) * 1000000
    WHEN 2 THEN (k % 40) * 86400000000 + (k % 24) * 3600000000 + (k % 60) * 1000000 + 250000 END AS us FROM o)
SELECT k AS o_orderkey,
       CASE WHEN us < 0 THEN '-' ELSE '' END || lpad(CAST(abs(us) // 3600000000 AS VARCHAR), CAST(greatest(2, length(CAST(abs(us) // 3600000000 AS VARCHAR))) AS INTEGER), '0')
         || ':' || lpad(CAST(abs(us) // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(us) // 1000000 % 60 AS VARCHAR), 2, '0')
         || '.' || lpad(CAST(abs(us) % 1000000 AS VARCHAR), 6, '0') AS interval,
       us IS NOT NULL OR NULL AS same
FROM u
""",
    "catalog_descriptor": DESCRIBED_SQL + 'SELECT des.* EXCLUDE (tbl), tbl AS "table" FROM des',
    "schema_drift": DRIFT_SQL + 'SELECT tbl AS "table", name, change, from_type, to_type FROM cmp WHERE change IS NOT NULL',
    "drift_summary": DRIFT_SQL + """
SELECT tbl AS "table", count(change) = 0 AS in_sync,
       coalesce(string_agg(name, ';' ORDER BY name) FILTER (change = 'added'), '') AS added,
       coalesce(string_agg(name, ';' ORDER BY name) FILTER (change = 'removed'), '') AS removed,
       coalesce(string_agg(name || ':' || from_type || '>' || to_type, ';' ORDER BY name) FILTER (change = 'type_changed'), '') AS type_changed,
       coalesce(string_agg(name, ';' ORDER BY name) FILTER (change = 'unmapped'), '') AS unmapped
FROM cmp GROUP BY tbl
""",
    "schema_state": DRIFT_SQL + """
, g AS (SELECT tbl, count(change) AS n, count(*) FILTER (change = 'unmapped') AS bad FROM cmp GROUP BY tbl)
SELECT tbl AS "table", CASE WHEN n > 0 THEN 'schema_drift' ELSE 'in_sync' END AS found,
       n > 0 AND bad = 0 AS reconciled, CASE WHEN n > 0 AND bad > 0 THEN 'schema_drift' ELSE 'in_sync' END AS state
FROM g
""",
    "schema_reconcile": DESCRIBED_SQL + """
, drifted AS (
  SELECT DISTINCT tbl FROM mc
  WHERE (unmapped IS NULL AND (p_partkey % 7 = 0 OR (p_partkey % 11 = 0 AND lake_type <> 'STRING'))) OR p_partkey % 13 = 0)
SELECT des.* EXCLUDE (tbl), tbl AS "table" FROM des WHERE tbl IN (SELECT tbl FROM drifted)
""",
    "lossy_report": CATALOG_SQL + """
SELECT tbl AS "table", count(*) AS n_lossy,
       string_agg(name || '|' || pg_type || '|' || lake_type || '|' || note, ';' ORDER BY position) AS lossy_columns
FROM mc WHERE lossy GROUP BY tbl
""",
    "schema_history": CATALOG_SQL + """
, s AS (SELECT tbl, name, position, pg_type, snapshot FROM col, (VALUES (1), (2), (3), (4), (5)) v(snapshot)
        WHERE position < CASE WHEN snapshot < 3 THEN 10 WHEN snapshot = 3 THEN 15 ELSE 20 END),
l AS (SELECT tbl, snapshot, string_agg(position || name || pg_type, ',' ORDER BY position) AS cols FROM s GROUP BY ALL),
c AS (SELECT *, cols IS DISTINCT FROM lag(cols) OVER (PARTITION BY tbl ORDER BY snapshot) AS changed FROM l)
SELECT tbl AS "table", snapshot, changed,
       CAST(sum(CAST(changed AS INTEGER)) OVER (PARTITION BY tbl ORDER BY snapshot) AS BIGINT) AS schema_version
FROM c
""",
    "typed_feed": MESSAGES_SQL + """
SELECT project, off AS "offset", user_id, CAST(amount AS DECIMAL(10,2)) AS value, replace(props, ': ', ':') AS props,
       CASE WHEN cls = 'extra' THEN 'x' || (event_id % 5) END AS extra, n_op AS op
FROM feed
""",
    "cast_report": MESSAGES_SQL + """
, v AS (SELECT user_id, CAST(amount AS DECIMAL(10,2)) AS a, cls, props FROM feed)
SELECT 'user_id' AS name, 'smallint' AS pg_type, 'SHORT' AS lake_type, count(*) AS present,
       count(*) FILTER (user_id > 32767) AS nulled, CAST(0 AS BIGINT) AS altered FROM v
UNION ALL SELECT 'value', 'numeric(3,1)', 'DECIMAL(3,1)', count(*), count(*) FILTER (abs(a) >= 99.95),
       count(*) FILTER (abs(a) < 99.95 AND CAST(a * 100 AS BIGINT) % 10 <> 0) FROM v
UNION ALL SELECT 'props', 'json', 'STRING', count(*), 0, 0 FROM v
UNION ALL SELECT 'extra', 'integer', 'INTEGER', count(*) FILTER (cls = 'extra'), count(*) FILTER (cls = 'extra'), 0 FROM v
""",
}
_SCALARS = ORACLE["encode_values"]
ORACLE["encode_arrays"] = """
WITH v AS (""" + _SCALARS + """),
e AS (
  SELECT o_orderkey, encoding,
         CASE WHEN stored IS NULL THEN 'null' ELSE '"' || replace(replace(stored, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' END AS x
  FROM v WHERE encoding <> 'array-1d')
SELECT o_orderkey, encoding,
       CASE WHEN o_orderkey % 2 = 0 THEN '[' || x || ',null,null,' || x || ']' ELSE '[' || x || ',null]' END AS flat,
       CASE WHEN o_orderkey % 2 = 0 THEN '[[' || x || ',null],[null,' || x || ']]' ELSE '[[' || x || ',null]]' END AS nested
FROM e
"""
