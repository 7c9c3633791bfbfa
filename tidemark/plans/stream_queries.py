"""Queries that go through stored feeds and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json_text import json_or_text
from tidemark.operators import collapse, merge
from tidemark.plans import fixtures as fx
from tidemark.plans.feed_queries import MESSAGES_SQL
from tidemark.plans.inbox_queries import CHANGES_SQL
from tidemark.session import new_work_folder
from tidemark.sources import cdc, feed, views
from tidemark.sources.inbox_store import Inbox
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import current, forward, reverse

_FEEDS: dict[tuple[str, str], str] = {}


def _deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """B. All messages in three deliveries; later ones repeat a part of the earlier."""
    messages = fx.messages(spark, sf_dir)
    third = fx.table(spark, sf_dir, "events").count() // 3
    offset = F.col("offset")
    again = offset % 10 == 0
    return [
        messages.filter(offset < third),
        messages.filter(((offset >= third) & (offset < 2 * third)) | (again & (offset < third))),
        messages.filter((offset >= 2 * third) | again),
    ]


def offset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery less what the ones before it committed."""
    whole, *later = _deliveries(spark, sf_dir)
    for delivery in later:
        fresh = collapse.drop_committed(delivery, collapse.high_water(whole))
        whole = whole.unionByName(fresh)
    return whole


def _feed(spark: SparkSession, sf_dir: str) -> str:
    """A feed that took the three deliveries, one append each."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FEEDS:
        root = new_work_folder(spark, "feed")
        for delivery in _deliveries(spark, sf_dir):
            feed.append(delivery, root)
        _FEEDS[key] = root
    return _FEEDS[key]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project", "table", "partition", "offset", "version",
        F.col("_op").alias("op"), F.col("_ts_ms").alias("ts_ms"), F.col("_deleted").alias("deleted"), "data",
    )


def feed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(feed.read_feed(spark, _feed(spark, sf_dir)))


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.read_rejects(spark, _feed(spark, sf_dir))


def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the feeds of the three tables, by name."""
    root = _feed(spark, sf_dir)
    names = [feed.register_view(spark, root, p, "accounts", fx.ACCOUNT_COLUMNS) for p in ("p0", "p1", "p2")]
    whole = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return spark.sql(f"""
        SELECT project, _op AS op, count(*) AS changes, count(DISTINCT user_id) AS accounts,
               sum(try_cast(value AS DECIMAL(10,2))) AS amount
        FROM ({whole}) GROUP BY project, _op ORDER BY project, _op""")


def feed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one project by name, without a column list; columns came with the second commit."""
    root = new_work_folder(spark, "shop-feed")
    for delivery in fx.shop_deliveries(spark, sf_dir):
        feed.append(delivery, root)
        views.register_views(spark, root, "shop")
    return spark.sql("""
        SELECT o.id, o.cust, o.op, o.version, o.offset, o.tags, CAST(o.total AS DECIMAL(18,2)) AS total, c.name,
               CAST(c.balance AS DECIMAL(18,2)) AS balance, o._version AS order_since, c._version AS customer_since
        FROM proj_shop_orders o LEFT JOIN proj_shop_customers c ON o.cust = c.id""")


def feed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the same tables, from states merged commit by commit."""
    root = new_work_folder(spark, "shop-feed")
    for delivery in fx.shop_deliveries(spark, sf_dir):
        feed.append(delivery, root)
        found = views.columns(spark, root)
    kind = F.regexp_replace("type", r"\d+,", "")  # digits depend on the values
    return found.select("table", "name", "since", kind.alias("type"))


def forward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three deliveries as a file stream, the checkpoint being lost once."""
    source, root = new_work_folder(spark, "log"), new_work_folder(spark, "stream-feed")
    places = [new_work_folder(spark, "checkpoint") for _ in range(2)]
    for delivery, checkpoint in zip(_deliveries(spark, sf_dir), (places[0], places[0], places[1]), strict=True):
        delivery.write.mode("append").parquet(source)
        stream = cdc.stream_files(spark, source)
        forward.start(stream, root, checkpoint, interval=None).awaitTermination()
    return _shown(feed.read_feed(spark, root)).drop("version")


def feed_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in files of interleaved offsets, one file a trigger, some twice in a file and in another."""
    source, root = new_work_folder(spark, "log"), new_work_folder(spark, "bounded-feed")
    messages, offset = fx.messages(spark, sf_dir), F.col("offset")
    twice = messages.filter(offset % 7 == 0)
    late = messages.filter(offset % 11 == 0).withColumn("_file", (offset + 1) % 4)
    messages = messages.unionByName(twice).withColumn("_file", offset % 4).unionByName(late)
    messages.repartition(4, "_file").drop("_file").write.parquet(source)
    stream = cdc.stream_files(spark, source, max_files_per_trigger=1)
    forward.start(stream, root, new_work_folder(spark, "checkpoint"), interval=None).awaitTermination()
    return _shown(feed.read_feed(spark, root)).drop("version")


def incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state kept by a stream over the three deliveries."""
    source, checkpoint = new_work_folder(spark, "log"), new_work_folder(spark, "checkpoint")
    state = current.state_table(new_work_folder(spark, "state"), fx.ACCOUNT_COLUMNS, ("user_id",), buckets=8)
    for delivery in _deliveries(spark, sf_dir):
        delivery.write.mode("append").parquet(source)
        stream = cdc.stream_files(spark, source)
        current.start(stream, fx.ACCOUNT_COLUMNS, state, checkpoint, interval=None).awaitTermination()
    return _account_state(current.live_rows(spark, state))


def _account_state(rows: DataFrame) -> DataFrame:
    return rows.select(
        "project", "user_id",
        F.col("value").try_cast("decimal(10,2)").alias("amount"),
        json_or_text(F.col("props")).alias("props"),
        "extra", F.col("_op").alias("op"), F.col("_ts_ms").alias("ts_ms"),
    )


def feed_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in one trigger, as versions of at most a sixth of them (rounded up)."""
    source, root = new_work_folder(spark, "log"), new_work_folder(spark, "limited-feed")
    fx.messages(spark, sf_dir).write.parquet(source)
    most = fx.table(spark, sf_dir, "events").count() // 6 + 1
    stream, checkpoint = cdc.stream_files(spark, source), new_work_folder(spark, "checkpoint")
    forward.start(stream, root, checkpoint, interval=None, max_records=most).awaitTermination()
    return _shown(feed.read_feed(spark, root))


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state by a streaming aggregation over the three deliveries, the stream being restarted for each."""
    source, checkpoint = new_work_folder(spark, "log"), new_work_folder(spark, "checkpoint")
    root, keys = new_work_folder(spark, "state-log"), ("user_id",)
    for delivery in _deliveries(spark, sf_dir):
        delivery.write.mode("append").parquet(source)
        stream = cdc.stream_files(spark, source)
        current.start_changes(stream, fx.ACCOUNT_COLUMNS, keys, root, checkpoint, interval=None).awaitTermination()
    return _account_state(current.live_changes(spark, fx.ACCOUNT_COLUMNS, keys, root))


_CHANGE_COLUMNS = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DECIMAL(18,2), l_extendedprice DECIMAL(18,2)"


def _orders_table(spark: SparkSession, sf_dir: str) -> KeyedTable:
    target = KeyedTable(
        new_work_folder(spark, "target"),
        "l_orderkey BIGINT, status STRING, l_extendedprice DECIMAL(18,2), l_partkey BIGINT",
        ("l_orderkey",), buckets=8,
    )
    target.merge(fx.order_target(spark, sf_dir).withColumn("op", F.lit(merge.UPSERT)))
    return target


def _inbox(spark: SparkSession) -> Inbox:
    box = Inbox(new_work_folder(spark, "inbox"), ("l_orderkey",))
    box.create(spark, _CHANGE_COLUMNS)
    return box


def reverse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C whole, in three commits of an inbox: one streamed into the target, then two at once."""
    box, target = _inbox(spark), _orders_table(spark, sf_dir)
    changes, checkpoint = fx.inbox_changes(spark, sf_dir), new_work_folder(spark, "checkpoint")
    day = F.col("_commit_version")
    early, middle, late = (changes.filter(day < 11000), changes.filter(day.between(11000, 11399)), changes.filter(day >= 11400))
    for commits in ((early,), (middle, late)):
        for part in commits:
            box.write_changes(spark, part, "merge")
        stream = reverse.start(spark, box, target, checkpoint, interval=None, order=fx.CHANGE_ORDER)
        stream.awaitTermination()
    return target.read(spark)


def reverse_inboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C parted into two inboxes of one table, read in turn: each goes on from its own mark."""
    west, east, target = _inbox(spark), _inbox(spark), _orders_table(spark, sf_dir)
    changes, routes = fx.inbox_changes(spark, sf_dir), {"west": (west, target), "east": (east, target)}
    early, half = F.col("_commit_version") < 11000, F.col("l_suppkey") % 2 == 0
    for commits in (((west, half & early), (east, ~half)), ((west, half & ~early),)):
        for box, part in commits:
            box.write_changes(spark, changes.filter(part), "merge")
        for error in reverse.process_all(spark, routes, fx.CHANGE_ORDER).values():
            if isinstance(error, Exception):
                raise error
    return target.read(spark)


QUERIES = {
    "offset_dedup": offset_dedup,
    "feed_append": feed_append,
    "feed_rejects": feed_rejects,
    "feed_scan": feed_scan,
    "feed_views": feed_views,
    "feed_columns": feed_columns,
    "forward_stream": forward_stream,
    "feed_bounded": feed_bounded,
    "incremental_state": incremental_state,
    "reverse_stream": reverse_stream,
    "feed_limited": feed_limited,
    "streamed_state": streamed_state,
    "reverse_inboxes": reverse_inboxes,
}

_STATE_SQL = MESSAGES_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project, user_id ORDER BY ts_ms DESC, part DESC, off DESC) AS rn
  FROM feed)
SELECT project, user_id, CAST(amount AS DECIMAL(10,2)) AS amount, replace(props, ': ', ':') AS props,
       CASE WHEN cls = 'extra' THEN 'x' || (event_id % 5) END AS extra, n_op AS op, ts_ms
FROM ranked WHERE rn = 1 AND deleted = 'false'
"""


def _in_turn_sql(batches: list[tuple[str, str]]) -> str:
    """D after batches of C in turn, each the changes of a condition by commit: a row that was deleted
    and comes back has lost its status."""
    steps = """
, t0 AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(NULL AS BIGINT) AS part FROM orders)"""
    for i, (condition, commit) in enumerate(batches):
        steps += f"""
, r{i} AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {commit} DESC,
     CASE WHEN _change_type = 'delete' THEN 0 ELSE 1 END DESC, l_linenumber DESC,
     l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM ch WHERE l_orderkey IS NOT NULL AND _change_type <> 'update_preimage' AND {condition}),
n{i} AS (SELECT l_orderkey AS k, _change_type = 'delete' AS gone, l_extendedprice AS price, l_partkey AS part FROM r{i} WHERE rn = 1),
t{i + 1} AS (
  SELECT coalesce(t{i}.k, n{i}.k) AS k, status, coalesce(n{i}.price, t{i}.price) AS price, coalesce(n{i}.part, t{i}.part) AS part
  FROM t{i} FULL OUTER JOIN n{i} ON t{i}.k = n{i}.k WHERE n{i}.gone IS NULL OR NOT n{i}.gone)"""
    return CHANGES_SQL + steps + f"""
SELECT k AS l_orderkey, status, price AS l_extendedprice, part AS l_partkey FROM t{len(batches)}
"""



# The version a message lands in: the delivery that brings it first, from 0.
DELIVERED_SQL = MESSAGES_SQL + """
, size AS (SELECT count(*) // 3 AS third FROM events),
del AS (SELECT norm.*, least(off // third, 2) AS version FROM norm, size)
"""

ORACLE = {
    "offset_dedup": MESSAGES_SQL + """
SELECT topic, part AS partition, off AS "offset", value FROM raw
""",
    "feed_append": DELIVERED_SQL + """
SELECT project, 'accounts' AS "table", part AS partition, off AS "offset", version, n_op AS op, ts_ms,
       deleted = 'true' AS deleted, data
FROM del WHERE reason IS NULL
""",
    "feed_rejects": DELIVERED_SQL + """
SELECT topic, part AS partition, off AS "offset", reason, version FROM del WHERE reason IS NOT NULL AND reason <> 'tombstone'
""",
    "feed_scan": MESSAGES_SQL + """
SELECT project, n_op AS op, count(*) AS changes, count(DISTINCT user_id) AS accounts,
       CAST(sum(CAST(amount AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS amount
FROM feed GROUP BY project, n_op
""",
    "feed_views": """
SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS op,
       CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS VARCHAR) END AS version,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 5 = 0 END AS "offset",
       CASE WHEN o_orderkey % 2 = 1 THEN '{"n":[' || o_orderkey || ',1],"p":"' || o_orderpriority || '"}' END AS tags,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total, c_name AS name,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS balance,
       o_orderkey % 2 AS order_since, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey IS NOT NULL THEN 0 END AS customer_since
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""",
    "feed_columns": """
WITH c(tbl, name, since, type) AS (VALUES
  ('orders', 'id', 0, 'BIGINT'), ('orders', 'cust', 0, 'BIGINT'), ('orders', 'total', 0, 'DECIMAL(2)'),
  ('orders', 'op', 0, 'STRING'), ('orders', 'version', 1, 'STRING'), ('orders', 'offset', 1, 'BOOLEAN'),
  ('orders', 'tags', 1, 'STRING'), ('customers', 'id', 0, 'BIGINT'), ('customers', 'name', 0, 'STRING'),
  ('customers', 'balance', 1, 'DECIMAL(2)'))
SELECT tbl AS "table", name, since, type FROM c
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 2 = 1 AND tbl = 'orders') OR tbl = 'customers'
""",
    "forward_stream": MESSAGES_SQL + """
SELECT project, 'accounts' AS "table", part AS partition, off AS "offset", n_op AS op, ts_ms, deleted = 'true' AS deleted, data
FROM feed
""",
    "feed_bounded": MESSAGES_SQL + """
SELECT project, 'accounts' AS "table", part AS partition, off AS "offset", n_op AS op, ts_ms, deleted = 'true' AS deleted, data
FROM feed
""",
    "incremental_state": _STATE_SQL,
    "streamed_state": _STATE_SQL,
    "feed_limited": MESSAGES_SQL + """
, cut AS (
  SELECT *, (row_number() OVER (ORDER BY topic, part, off) - 1) // ((SELECT count(*) FROM events) // 6 + 1) AS version
  FROM norm)
SELECT project, 'accounts' AS "table", part AS partition, off AS "offset", version, n_op AS op, ts_ms,
       deleted = 'true' AS deleted, data
FROM cut WHERE reason IS NULL
""",
    "reverse_stream": _in_turn_sql([
        ("_commit_version < 11000", "_commit_version < 11000"),
        ("_commit_version >= 11000", "(_commit_version >= 11400)"),
    ]),
    "reverse_inboxes": _in_turn_sql([
        ("l_suppkey % 2 = 0 AND _commit_version < 11000", "1"),
        ("l_suppkey % 2 <> 0", "1"),
        ("l_suppkey % 2 = 0 AND _commit_version >= 11000", "1"),
    ]),
}
