"""Queries over ledgers and object inventories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import collapse, inventory, metrics
from tidemark.operators.envelope import route
from tidemark.plans import fixtures as fx
from tidemark.plans.feed_queries import MESSAGES_SQL
from tidemark.sources import feed

# 2024-01-18 as a number of three-day spans: what is committed for the lag.
COMMITTED = 6580


def sink_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(fx.ledger_entries(spark, sf_dir))


def feed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = feed.history(fx.ledger_entries(spark, sf_dir))
    return commits.select("version", "operation", F.unix_micros("commit_ts").alias("commit_us"), "rows")


def feed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fx.ledger_entries(spark, sf_dir).filter(F.col("version") < COMMITTED)
    marks = entries.groupBy("topic", "partition").agg(F.max("max_offset").alias("max_offset"))
    ends = collapse.high_water(fx.messages(spark, sf_dir)).withColumnRenamed("max_offset", "end_offset")
    routed = route(ends).filter(F.col("project").isNotNull())
    return metrics.lag(routed, marks, ["project"])


def sink_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate(fx.ledger_entries(spark, sf_dir))


def inventory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.reconcile(fx.objects(spark, sf_dir), fx.registered_tables(spark, sf_dir))


def inbox_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inbox_locations(fx.objects(spark, sf_dir))


QUERIES = {
    "sink_counters": sink_counters,
    "feed_history": feed_history,
    "feed_lag": feed_lag,
    "sink_rate": sink_rate,
    "inventory_reconcile": inventory_reconcile,
    "inbox_discovery": inbox_discovery,
}

LEDGER_SQL = MESSAGES_SQL + """
, led AS (
  SELECT epoch_us(ts) // 259200000000 AS version, topic, project, owner, part, max(off) AS max_offset,
         count(*) FILTER (reason IS NULL) AS n, max(ts) AS commit_ts
  FROM norm GROUP BY ALL)
"""
OBJECTS_SQL = """
WITH obj AS (
  SELECT doc_id, 'p' || (doc_id % 5) || '/t' || (doc_id % 40) || CASE WHEN doc_id % 40 >= 30 THEN '_inbox' ELSE '' END AS folder
  FROM documents),
loc AS (SELECT DISTINCT folder FROM obj WHERE doc_id % 3 <> 0),
reg AS (
  SELECT 'p' || (doc_id % 5) AS p, 't' || (doc_id % 40) AS t FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 40 < 30
  UNION SELECT 'p9', 't' || (doc_id % 100) FROM documents WHERE doc_id % 50 = 0)
"""

ORACLE = {
    "sink_counters": LEDGER_SQL + """
SELECT project, 'accounts' AS "table", CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT version) FILTER (n > 0) AS flushes
FROM led WHERE project = owner GROUP BY project
""",
    "feed_history": LEDGER_SQL + """
SELECT version, 'append' AS operation, epoch_us(max(commit_ts)) AS commit_us, CAST(sum(n) AS BIGINT) AS rows
FROM led GROUP BY version
""",
    "feed_lag": LEDGER_SQL + f"""
, e AS (SELECT project, part, max(off) AS e FROM raw WHERE project = owner GROUP BY ALL),
m AS (SELECT project, part, max(max_offset) AS m FROM led WHERE project = owner AND version < {COMMITTED} GROUP BY ALL)
SELECT project, CAST(sum(e - coalesce(m, -1)) AS BIGINT) AS lag FROM e LEFT JOIN m USING (project, part) GROUP BY project
""",
    "sink_rate": LEDGER_SQL + """
SELECT project, 'accounts' AS "table", epoch_us(commit_ts) // 60000000 * 60 AS window_start,
       CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) / 60 AS rows_per_second
FROM led WHERE project = owner GROUP BY ALL
""",
    "inventory_reconcile": OBJECTS_SQL + """
SELECT 'register' AS action, 'proj_' || split_part(folder, '/', 1) AS schema, split_part(folder, '/', 2) AS "table", folder AS location
FROM loc WHERE folder NOT IN (SELECT p || '/' || t FROM reg)
UNION ALL
SELECT 'unregister', 'proj_' || p, t, p || '/' || t FROM reg WHERE p || '/' || t NOT IN (SELECT folder FROM loc)
UNION ALL
SELECT DISTINCT 'drop_schema', 'proj_' || p, NULL, NULL FROM reg WHERE p NOT IN (SELECT split_part(folder, '/', 1) FROM loc)
""",
    "inbox_discovery": OBJECTS_SQL + """
SELECT folder AS location, split_part(folder, '/', 1) AS project, replace(split_part(folder, '/', 2), '_inbox', '') AS "table"
FROM loc WHERE folder LIKE '%_inbox'
""",
}
