"""Columns of raw JSON rows: the union over all rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer_columns(feed: DataFrame) -> DataFrame:
    """One row per column of each table found in the JSON text ``data``.

    A column that is null in every row is left out, so that its first value can
    set the type. Objects and arrays are stored as JSON text; so is a column
    whose values disagree, which is reported as ``mixed``.
    """
    parsed = feed.select("project", "table", F.try_parse_json("data").alias("_doc"))
    fields = parsed.sparkSession.sql(
        "SELECT project, table, key AS name, value FROM {docs}, LATERAL variant_explode(_doc)", docs=parsed
    )
    observed = fields.groupBy("project", "table", "name").agg(
        F.schema_of_variant_agg("value").alias("seen"),
        F.count("*").alias("n_present"),
        F.count_if(~F.is_variant_null("value")).alias("n_non_null"),
    )
    nested = F.col("seen").rlike("^(OBJECT|ARRAY)")
    mixed = F.col("seen") == "VARIANT"
    as_text = nested | mixed
    return observed.filter(F.col("seen") != "VOID").select(
        "project",
        "table",
        "name",
        F.when(as_text, "STRING").otherwise(F.col("seen")).alias("type"),
        nested.alias("nested"),
        mixed.alias("mixed"),
        "n_present",
        "n_non_null",
    )


#: What is known of a column, all of it mergeable: flags and sizes by max, counts by sum.
KINDS = ("booleans", "integers", "decimals", "doubles", "strings", "nested", "mixed")
SIZES = ("digits", "scale")
COUNTS = ("n_present", "n_non_null")
COLUMN_STATE = (
    "project STRING, table STRING, name STRING, since BIGINT, "
    + ", ".join(f"{k} BOOLEAN" for k in KINDS)
    + ", digits INT, scale INT, n_present BIGINT, n_non_null BIGINT"
)
# A decimal holds so many digits; Spark gives a 64-bit integer among decimals 20.
_DECIMAL, _INTEGER = 38, 20


def column_state(feed: DataFrame) -> DataFrame:
    """What the JSON text ``data`` of these rows says about the columns of each table.

    ``since`` is the first ``version`` a column occurs in. States of different rows
    become that of all of them by ``merge_states``.
    """
    parsed = feed.select("project", "table", "version", F.try_parse_json("data").alias("_doc"))
    fields = parsed.sparkSession.sql(
        "SELECT project, table, version, key AS name, value FROM {docs}, LATERAL variant_explode(_doc)", docs=parsed
    )
    seen = F.schema_of_variant_agg("value")
    found = fields.groupBy("project", "table", "name").agg(
        F.min("version").alias("since"),
        seen.alias("seen"),
        F.count("*").alias("n_present"),
        F.count_if(~F.is_variant_null("value")).alias("n_non_null"),
    )
    kind = {
        "booleans": F.col("seen") == "BOOLEAN",
        "integers": F.col("seen") == "BIGINT",
        "decimals": F.col("seen").startswith("DECIMAL"),
        "doubles": F.col("seen").isin("DOUBLE", "FLOAT"),
        "strings": F.col("seen") == "STRING",
        "nested": F.col("seen").rlike("^(OBJECT|ARRAY)"),
        "mixed": F.col("seen") == "VARIANT",
    }
    precision, scale = (F.regexp_extract("seen", r"^DECIMAL\((\d+),(\d+)\)$", i).try_cast("int") for i in (1, 2))
    return found.select(
        "project",
        "table",
        "name",
        "since",
        *[c.alias(k) for k, c in kind.items()],
        F.coalesce(precision - scale, F.lit(0)).alias("digits"),
        F.coalesce(scale, F.lit(0)).alias("scale"),
        *COUNTS,
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from any number of them, in any order."""
    return states.groupBy("project", "table", "name").agg(
        F.min("since").alias("since"),
        *[F.bool_or(k).alias(k) for k in KINDS],
        *[F.max(c).alias(c) for c in SIZES],
        *[F.sum(c).alias(c) for c in COUNTS],
    )


def column_types(states: DataFrame) -> DataFrame:
    """Columns with the type that holds all their values: project, table, name, since, type.

    A column without values is left out, so that its first value can set the type.
    Objects, arrays and columns whose values disagree are text.
    """
    number = F.col("integers") | F.col("decimals") | F.col("doubles")
    several = number.cast("int") + F.col("booleans").cast("int") + F.col("strings").cast("int") > 1
    digits = F.greatest("digits", F.when(F.col("integers"), _INTEGER).otherwise(0))
    width = digits + F.col("scale")
    decimal = F.concat(F.lit("DECIMAL("), width, F.lit(","), F.col("scale"), F.lit(")"))
    type_ = (
        F.when(F.col("mixed") | F.col("nested") | several | F.col("strings"), "STRING")
        .when(F.col("booleans"), "BOOLEAN")
        .when(F.col("doubles") | (F.col("decimals") & (width > _DECIMAL)), "DOUBLE")
        .when(F.col("decimals"), decimal)
        .otherwise("BIGINT")
    )
    return states.filter("n_non_null > 0").select("project", "table", "name", "since", type_.alias("type"))


def drop_null_columns(rows: DataFrame) -> DataFrame:
    """Leave out the columns that hold no value in this batch; one pass."""
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if counts[c] > 0])


def union_by_name(batches: list[DataFrame]) -> DataFrame:
    """The column union of batches, missing columns being null."""
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch, allowMissingColumns=True)
    return whole
