"""Queries over the change feed, each with its SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json_text import canonical_json, json_or_text
from tidemark.operators import collapse, envelope, infer
from tidemark.plans import fixtures as fx
from tidemark.sources import cdc

# Fixture A as SQL. `cls` is the one malformation of a message, if any.
MESSAGES_SQL = """
WITH ev AS (
  SELECT event_id, user_id, props, ts,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
         epoch_us(ts) // 1000 AS ts_ms,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS deleted,
         'p' || (user_id % 3) AS project,
         CASE WHEN event_id % 97 = 0 THEN 'p' || ((user_id + 1) % 3) ELSE 'p' || (user_id % 3) END AS owner,
         CAST(user_id % 4 AS INTEGER) AS part,
         event_id AS off,
         CASE WHEN event_id % 97 = 0 THEN 'topic' WHEN event_id % 89 = 0 THEN 'tombstone'
              WHEN event_id % 83 = 0 THEN 'meta' WHEN event_id % 79 = 0 THEN 'no_op'
              WHEN event_id % 73 = 0 THEN 'extra' WHEN event_id % 71 = 0 THEN 'broken' ELSE '' END AS cls
  FROM events
),
msg AS (
  SELECT *, 'cdc.' || project || '.proj_' || owner || '.accounts' AS topic,
         '"user_id":' || user_id || ',"value":"' || amount || '","props":' || props AS d,
         '"__op":"' || op || '"' AS o,
         '"__ts_ms":' || ts_ms || ',"__deleted":"' || deleted || '"' AS m,
         '"extra":"x' || (event_id % 5) || '"' AS x
  FROM ev
),
raw AS (
  SELECT *, CASE cls WHEN 'tombstone' THEN NULL
                     WHEN 'meta' THEN '{' || o || ',' || m || '}'
                     WHEN 'no_op' THEN '{' || d || ',' || m || '}'
                     WHEN 'extra' THEN '{' || d || ',' || x || ',' || o || ',' || m || '}'
                     WHEN 'broken' THEN '{' || d
                     ELSE '{' || d || ',' || o || ',' || m || '}' END AS value
  FROM msg
),
norm AS (
  SELECT *,
         CASE cls WHEN 'topic' THEN 'bad_topic' WHEN 'tombstone' THEN 'tombstone'
                  WHEN 'meta' THEN 'no_data_columns' WHEN 'broken' THEN 'invalid_json' END AS reason,
         CASE WHEN cls = 'no_op' THEN 'r' ELSE op END AS n_op,
         '{' || replace(d, '": ', '":') || CASE WHEN cls = 'extra' THEN ',' || x ELSE '' END || '}' AS data
  FROM raw
),
feed AS (SELECT * FROM norm WHERE reason IS NULL)
"""


def cdc_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.read_messages(fx.messages(spark, sf_dir), r"cdc\..*")


def route_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = envelope.route(fx.messages(spark, sf_dir))
    location = envelope.storage_location(F.col("project"), F.col("table"))
    return routed.select(
        "topic",
        "partition",
        "offset",
        "project",
        "table",
        F.when(F.col("project").isNotNull(), location).alias("location"),
    )


def cdc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.feed_rows(fx.messages(spark, sf_dir)).select(
        "project",
        "table",
        "partition",
        "offset",
        F.col("_op").alias("op"),
        F.col("_ts_ms").alias("ts_ms"),
        F.col("_deleted").alias("deleted"),
        "data",
    )


def cdc_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.rejects(fx.messages(spark, sf_dir))


def cdc_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = envelope.unwrap(fx.nested_messages(spark, sf_dir))
    rows = envelope.normalize(flat)
    return rows.select(
        "project",
        "partition",
        "offset",
        "reason",
        F.col("_op").alias("op"),
        F.col("_ts_ms").alias("ts_ms"),
        F.col("_deleted").alias("deleted"),
        "data",
    )


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = envelope.normalize_typed(fx.messages(spark, sf_dir), fx.ACCOUNT_COLUMNS)
    return rows.drop("topic")


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = collapse.current_state(_accounts(spark, sf_dir), ["project", "table", "user_id"])
    return live.select(
        "project",
        "user_id",
        F.col("value").try_cast("decimal(10,2)").alias("amount"),
        json_or_text(F.col("props")).alias("props"),
        "extra",
        F.col("_op").alias("op"),
        F.col("_ts_ms").alias("ts_ms"),
    )


def latest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = collapse.rank_changes(_accounts(spark, sf_dir), ["project", "table", "user_id"])
    return ranked.select(
        "project",
        "user_id",
        "offset",
        F.col("_ts_ms").alias("ts_ms"),
        F.col("_deleted").alias("deleted"),
        F.col("change_rank").cast("bigint").alias("change_rank"),
    )


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.high_water(fx.messages(spark, sf_dir))


def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")
    )
    start = cdc.snapshot_rows(rows, project="crm", table="customer", ts_ms=0)
    later = cdc.snapshot_rows(
        rows.filter(F.col("c_custkey") % 10 == 0).withColumn("c_name", F.upper("c_name")),
        project="crm", table="customer", ts_ms=1, op="u",
    )
    return start.unionByName(later).select(
        "project", "table", F.col("_op").alias("op"), F.col("_ts_ms").alias("ts_ms"),
        F.col("_deleted").alias("deleted"), "data",
    )


def _documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    doc = F.format_string(
        '{"z": {"b": [%d, {"y": "%s", "x": true}], "a": null}, "key" : %d , "k2": "%s"}',
        "o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority",
    )
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, doc)
        .when(kind == 1, F.format_string('[ %d , "%s" ]', "o_orderkey", "o_orderstatus"))
        .when(kind == 2, F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit('{"open": '), F.col("o_orderkey").cast("string")))
    )
    return o.select("o_orderkey", text.alias("text"))


def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents_json(spark, sf_dir)
    return docs.select(
        "o_orderkey",
        json_or_text(F.col("text")).alias("stored"),
        canonical_json(F.col("text")).alias("canonical"),
    )


def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = envelope.feed_rows(fx.messages(spark, sf_dir))
    return infer.infer_columns(feed)


QUERIES = {
    "cdc_read": cdc_read,
    "route_topic": route_topic,
    "cdc_normalize": cdc_normalize,
    "cdc_rejects": cdc_rejects,
    "cdc_unwrap": cdc_unwrap,
    "current_state": current_state,
    "latest_rank": latest_rank,
    "high_water": high_water,
    "snapshot_load": snapshot_load,
    "json_canonical": json_canonical,
    "schema_infer": schema_infer,
}

ORACLE = {
    "cdc_read": MESSAGES_SQL + """
SELECT topic, part AS partition, off AS "offset", value FROM raw
""",
    "route_topic": MESSAGES_SQL + """
SELECT topic, part AS partition, off AS "offset",
       CASE WHEN project = owner THEN project END AS project,
       CASE WHEN project = owner THEN 'accounts' END AS "table",
       CASE WHEN project = owner THEN 's3://warehouse/' || project || '/accounts' END AS location
FROM raw
""",
    "cdc_normalize": MESSAGES_SQL + """
SELECT project, 'accounts' AS "table", part AS partition, off AS "offset", n_op AS op, ts_ms,
       deleted = 'true' AS deleted, data
FROM feed
""",
    "cdc_rejects": MESSAGES_SQL + """
SELECT topic, part AS partition, off AS "offset", reason, value
FROM norm WHERE reason IS NOT NULL AND reason <> 'tombstone'
""",
    "cdc_unwrap": MESSAGES_SQL + """
, n AS (SELECT *, event_id % 89 = 0 AS gone FROM ev)
SELECT project, part AS partition, off AS "offset",
       CASE WHEN gone THEN 'tombstone' END AS reason,
       CASE WHEN NOT gone THEN op END AS op,
       CASE WHEN NOT gone THEN ts_ms END AS ts_ms,
       CASE WHEN NOT gone THEN op = 'd' END AS deleted,
       CASE WHEN NOT gone THEN '{"user_id":' || user_id || ',"value":"' || amount || '","props":'
            || replace(props, ': ', ':') || '}' END AS data
FROM n
""",
    "current_state": MESSAGES_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project, user_id ORDER BY ts_ms DESC, part DESC, off DESC) AS rn
  FROM feed)
SELECT project, user_id, CAST(amount AS DECIMAL(10,2)) AS amount, replace(props, ': ', ':') AS props,
       CASE WHEN cls = 'extra' THEN 'x' || (event_id % 5) END AS extra, n_op AS op, ts_ms
FROM ranked WHERE rn = 1 AND deleted = 'false'
""",
    "latest_rank": MESSAGES_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project, user_id ORDER BY ts_ms DESC, part DESC, off DESC) AS rn
  FROM feed)
SELECT project, user_id, off AS "offset", ts_ms, deleted = 'true' AS deleted, rn AS change_rank
FROM ranked WHERE rn = 1
""",
    "high_water": MESSAGES_SQL + """
SELECT topic, part AS partition, max(off) AS max_offset FROM raw GROUP BY ALL
""",
    "snapshot_load": """
WITH r AS (SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS bal FROM customer),
u AS (
  SELECT c_custkey, c_name, bal, 'r' AS op, 0 AS ts FROM r
  UNION ALL
  SELECT c_custkey, upper(c_name), bal, 'u', 1 FROM r WHERE c_custkey % 10 = 0)
SELECT 'crm' AS project, 'customer' AS "table", op, CAST(ts AS BIGINT) AS ts_ms, false AS deleted,
       '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_acctbal":"' || bal || '"}' AS data
FROM u
""",
    "json_canonical": """
WITH t AS (
  SELECT *, o_orderkey % 4 AS kind FROM orders),
s AS (
  SELECT o_orderkey, kind, o_orderpriority,
    CASE kind WHEN 0 THEN '{"k2":"' || o_orderpriority || '","key":' || o_orderkey || ',"z":{"a":null,"b":['
                          || o_custkey || ',{"x":true,"y":"' || o_orderstatus || '"}]}}'
              WHEN 1 THEN '[' || o_orderkey || ',"' || o_orderstatus || '"]' END AS canonical
  FROM t)
SELECT o_orderkey,
       CASE kind WHEN 2 THEN o_orderpriority WHEN 3 THEN '{"open": ' || o_orderkey ELSE canonical END AS stored,
       canonical
FROM s
""",
    "schema_infer": MESSAGES_SQL + """
, cols AS (
  SELECT project, 'user_id' AS name, 'BIGINT' AS type, CAST(user_id AS VARCHAR) AS v FROM feed
  UNION ALL SELECT project, 'value', 'STRING', amount FROM feed
  UNION ALL SELECT project, 'props', 'STRING', props FROM feed
  UNION ALL SELECT project, 'extra', 'STRING', 'x' FROM feed WHERE cls = 'extra')
SELECT project, 'accounts' AS "table", name, type, name = 'props' AS nested, false AS mixed,
       count(*) AS n_present, count(v) AS n_non_null
FROM cols GROUP BY ALL
""",
}
