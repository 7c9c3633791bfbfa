"""Object keys against registered tables: what to register and what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a folder a table, and the name of a project's schema.
LOG_FOLDER = "/_delta_log/"
INBOX = "_inbox"
SCHEMA_PREFIX = "proj_"


def _locations(objects: DataFrame, marker: str, keep: str) -> DataFrame:
    """The distinct texts before a marker, plus ``keep``."""
    key = F.col("key")
    at = F.instr(key, marker)
    location = F.concat(F.substring_index(key, marker, 1), F.lit(keep))
    return objects.filter(at > 1).select(location.alias("location")).distinct()


def table_locations(objects: DataFrame) -> DataFrame:
    """The table folders below a bucket, from the keys of its objects."""
    return _locations(objects, LOG_FOLDER, "")


def inbox_locations(objects: DataFrame) -> DataFrame:
    found = _locations(objects, INBOX + LOG_FOLDER, INBOX)
    return found.select(
        "location",
        F.substring_index("location", "/", 1).alias("project"),
        F.regexp_replace(_after_first(F.col("location")), f"{INBOX}$", "").alias("table"),
    )


def _after_first(location: Column) -> Column:
    return F.regexp_replace(location, "^[^/]*/", "")


def named(locations: DataFrame) -> DataFrame:
    """The schema and table name a location is registered under."""
    location = F.col("location")
    project = F.substring_index(location, "/", 1)
    deeper = F.translate(_after_first(location), "/", "_")
    table = F.when(location.contains("/"), deeper).otherwise(project)
    return locations.select(
        F.concat(F.lit(SCHEMA_PREFIX), project).alias("schema"), table.alias("table"), "location"
    )


def reconcile(objects: DataFrame, registered: DataFrame) -> DataFrame:
    """The steps that make the registered tables match the stored ones.

    ``registered`` has schema, table and location. A registration is kept if its
    location still exists, so tables in deeper folders are not dropped and made
    again each time. The objects are read once: all steps come from one full outer
    join of the stored and the registered locations.
    """
    found = named(table_locations(objects)).withColumnsRenamed({"schema": "_schema", "table": "_table"})
    both = found.withColumn("_found", F.lit(True)).join(
        registered.select("schema", "table", "location").withColumn("_known", F.lit(True)), "location", "full_outer"
    )
    none = F.lit(None).cast("string")

    def step(action: str, when: Column, schema: str, table: Column, location: Column) -> Column:
        row = F.struct(
            F.lit(action).alias("action"), F.col(schema).alias("schema"), table.alias("table"), location.alias("location"),
            F.col("_found").isNotNull().alias("stored"),
        )
        return F.when(when, row)

    stored, known, location = F.col("_found").isNotNull(), F.col("_known").isNotNull(), F.col("location")
    # Schemas are marked by either side; one with a registered and no stored table is to go.
    rows = F.array(
        step("register", stored & ~known, "_schema", F.col("_table"), location),
        step("unregister", known & ~stored, "schema", F.col("table"), location),
        step("drop_schema", stored, "_schema", none, none),
        F.when(known, F.struct(
            F.lit("drop_schema").alias("action"), F.col("schema"), none.alias("table"), none.alias("location"),
            F.lit(False).alias("stored"),
        )),
    )
    steps = both.select(F.explode(F.array_compact(rows)).alias("_s")).groupBy(
        "_s.action", "_s.schema", "_s.table", "_s.location"
    ).agg(F.bool_or("_s.stored").alias("_stored"))
    wanted = (F.col("action") != "drop_schema") | ~F.col("_stored")
    return steps.filter(wanted).select("action", "schema", "table", "location")
