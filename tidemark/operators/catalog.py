"""Column catalogues of many tables: types, drift, descriptors and versions.

A catalogue has one row per column: ``table, position, name, pg_type, nullable``.
A database table has at most 1,600 columns, which bounds every list built here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.type_map import constant_map, map_types
from tidemark.operators.running import Measure, find_cuts, running_before

# Lake type, catalogue type name, type name in field JSON.
DESCRIPTORS = (
    ("BOOLEAN", "BOOLEAN", "boolean"),
    ("SHORT", "SHORT", "short"),
    ("INTEGER", "INT", "integer"),
    ("INT", "INT", "integer"),
    ("LONG", "LONG", "long"),
    ("FLOAT", "FLOAT", "float"),
    ("DOUBLE", "DOUBLE", "double"),
    ("STRING", "STRING", "string"),
    ("BINARY", "BINARY", "binary"),
    ("DATE", "DATE", "date"),
    ("TIMESTAMP", "TIMESTAMP", "timestamp"),
    ("TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "timestamp_ntz"),
)
# Kinds of drift and states of a table.
ADDED, REMOVED, TYPE_CHANGED, UNMAPPED = "added", "removed", "type_changed", "unmapped"
IN_SYNC, SCHEMA_DRIFT = "in_sync", "schema_drift"
DECIMAL = r"^DECIMAL\((\d+),(\d+)\)$"
# Spellings of one lake type, used only where aliases are to be treated as equal.
ALIASES = {"INT": "INTEGER", "BIGINT": "LONG", "SMALLINT": "SHORT", "TINYINT": "BYTE"}


def column_catalog(
    attributes: DataFrame, classes: DataFrame, namespaces: DataFrame, indexes: DataFrame
) -> DataFrame:
    """The live columns of all tables, in order, from the database's catalogue.

    System columns and dropped ones are left out; ``is_key`` marks the columns of
    the primary key, however many they are.
    """
    live = attributes.filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
    keys = indexes.filter("indisprimary").select(
        F.col("indrelid").alias("attrelid"), F.explode("indkey").alias("attnum"), F.lit(True).alias("_key")
    )
    tables = classes.join(
        namespaces.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace"
    ).select(F.col("oid").alias("attrelid"), "nspname", "relname")
    joined = live.join(tables, "attrelid").join(keys, ["attrelid", "attnum"], "left")
    return joined.select(
        F.col("nspname").alias("schema"),
        F.col("relname").alias("table"),
        F.col("attnum").alias("position"),
        F.col("attname").alias("name"),
        F.col("format_type").alias("pg_type"),
        (~F.col("attnotnull")).alias("nullable"),
        F.coalesce("_key", F.lit(False)).alias("is_key"),
    )


def _comparable(lake_type: Column, aliases_equal: bool) -> Column:
    text = F.upper(F.trim(lake_type))
    if aliases_equal:
        text = F.regexp_replace(text, r"\s+", "")
        for name, standard in ALIASES.items():
            text = F.regexp_replace(text, rf"\b{name}\b", standard)
    return text


def schema_drift(
    columns: DataFrame,
    registered: DataFrame,
    table: Sequence[str] = ("table",),
    aliases_equal: bool = False,
) -> DataFrame:
    """The columns that differ between the tables and what is registered.

    ``registered`` has table, name and ``registered_type``. Types are compared as
    text, trimmed and in upper case; nullability does not count. A rename shows as
    removed and added. A type without a mapping is reported, not guessed.
    """
    want = map_types(columns).select(
        *table, "name", "position", "pg_type", F.col("lake_type").alias("_to"),
        F.col("unmapped").alias("_bad"), F.lit(True).alias("_pg"),
    )
    have = registered.select(*table, "name", F.col("registered_type").alias("_from"), F.lit(True).alias("_reg"))
    both = want.join(have, [*table, "name"], "full_outer")
    differs = _comparable(F.col("_to"), aliases_equal) != _comparable(F.col("_from"), aliases_equal)
    change = (
        F.when(F.col("_pg").isNull(), REMOVED)
        .when(F.col("_bad").isNotNull(), UNMAPPED)
        .when(F.col("_reg").isNull(), ADDED)
        .when(differs, TYPE_CHANGED)
    )
    return both.select(
        *table,
        "name",
        change.alias("change"),
        F.col("_from").alias("from_type"),
        F.col("_to").alias("to_type"),
        "position",
    )


def only_drift(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("change").isNotNull())


def drift_summary(compared: DataFrame, table: Sequence[str] = ("table",)) -> DataFrame:
    """Per table: whether it is in sync, and the lists of its differences."""

    def named(change: str, value: Column) -> Column:
        listed = F.collect_list(F.when(F.col("change") == change, value))
        return F.sort_array(listed)

    name = F.col("name")
    moved = F.struct(
        name.alias("column"), F.col("from_type").alias("from"), F.col("to_type").alias("to")
    )
    return compared.groupBy(*table).agg(
        (F.count("change") == 0).alias("in_sync"),
        named(ADDED, name).alias("added"),
        named(REMOVED, name).alias("removed"),
        named(TYPE_CHANGED, moved).alias("type_changed"),
        named(UNMAPPED, name).alias("unmapped"),
    )


def schema_states(compared: DataFrame, table: Sequence[str] = ("table",)) -> DataFrame:
    """Per table the state found, and the state after ``reconcile``.

    A table with a column nobody can map stays in drift.
    """
    per_table = compared.groupBy(*table).agg(
        F.count("change").alias("_changes"), F.count_if(F.col("change") == UNMAPPED).alias("_bad")
    )
    drifted = F.col("_changes") > 0
    repaired = drifted & (F.col("_bad") == 0)
    return per_table.select(
        *table,
        F.when(drifted, SCHEMA_DRIFT).otherwise(IN_SYNC).alias("found"),
        repaired.alias("reconciled"),
        F.when(drifted & ~repaired, SCHEMA_DRIFT).otherwise(IN_SYNC).alias("state"),
    )


def reconcile(
    columns: DataFrame, registered: DataFrame, table: Sequence[str] = ("table",), partial: bool = False
) -> DataFrame:
    """The registration to write again: all columns of each repairable table in drift.

    A column nobody can map keeps its table from being repaired. With ``partial`` it counts
    as not there: the other columns say whether a table is in drift, and are written.
    """
    if partial:
        columns = map_types(columns).filter(F.col("unmapped").isNull()).select(*columns.columns)
    states = schema_states(schema_drift(columns, registered, table), table)
    drifted = states.filter("reconciled").select(*table)
    return descriptors(columns.join(drifted, list(table), "left_semi"))


def descriptors(columns: DataFrame) -> DataFrame:
    """How a catalogue describes each mapped column."""
    mapped = map_types(columns).filter(F.col("unmapped").isNull())
    base = F.regexp_replace("lake_type", r"^(ARRAY<)+|>+$", "")
    dims = F.length("lake_type") - F.length(F.regexp_replace("lake_type", ">", ""))
    known = constant_map(DESCRIPTORS, ("name", "json"))
    mapped = mapped.withColumns({"_base": base, "_dims": dims})
    mapped = mapped.withColumn("_known", F.try_element_at(known, F.col("_base")))
    precision = F.regexp_extract("_base", DECIMAL, 1).try_cast("int")
    scale = F.regexp_extract("_base", DECIMAL, 2).try_cast("int")
    is_array = F.col("_dims") > 0
    field = F.coalesce("_known.json", F.lower("_base"))
    inner = F.concat(
        F.repeat(F.lit('{"type":"array","elementType":'), F.col("_dims")),
        F.lit('"'), field, F.lit('"'),
        F.repeat(F.lit(',"containsNull":true}'), F.col("_dims")),
    )
    type_json = F.concat(
        F.expr("substring(to_json(named_struct('name', name)), 1, length(to_json(named_struct('name', name))) - 1)"),
        F.lit(',"type":'), inner,
        F.lit(',"nullable":'), F.col("nullable").cast("string"), F.lit(',"metadata":{}}'),
    )
    return mapped.select(
        *[c for c in columns.columns if c != "pg_type"],
        F.lower("lake_type").alias("type_text"),
        F.when(is_array, "ARRAY").otherwise(F.coalesce("_known.name", F.lit("DECIMAL"))).alias("type_name"),
        type_json.alias("type_json"),
        F.when(~is_array, precision).alias("type_precision"),
        F.when(~is_array, scale).alias("type_scale"),
    )


def lossy_report(columns: DataFrame, table: Sequence[str] = ("table",)) -> DataFrame:
    """Per table the columns whose conversion loses information, in order."""
    lossy = map_types(columns).filter("lossy")
    entry = F.struct("position", F.col("name").alias("column"), "pg_type", "lake_type", "note")
    return lossy.groupBy(*table).agg(
        F.count("*").alias("n_lossy"), F.sort_array(F.collect_list(entry)).alias("lossy_columns")
    )


def schema_history(
    snapshots: DataFrame, table: Sequence[str] = ("table",), cuts: int | None = None
) -> DataFrame:
    """Number the column lists a table had; a snapshot without change keeps its number.

    ``snapshots`` is a catalogue with a ``snapshot`` number.
    """
    columns = F.sort_array(F.collect_list(F.struct("position", "name", "pg_type")))
    lists = snapshots.groupBy(*table, "snapshot").agg(F.sha2(F.to_json(columns), 256).alias("_list"))
    ranges = find_cuts(lists, table, ["snapshot"], cuts)
    before = {"_before": Measure("last", F.col("_list"))}
    seen = running_before(ranges.assign(lists), ranges, before)
    seen = seen.withColumn("changed", ~F.col("_list").eqNullSafe(F.col("_before")))
    counted = running_before(seen, ranges, {"_earlier": Measure("count", F.col("changed"))})
    number = F.coalesce("_earlier", F.lit(0)) + F.col("changed").cast("bigint")
    return counted.select(*table, "snapshot", "changed", number.cast("bigint").alias("schema_version"))
