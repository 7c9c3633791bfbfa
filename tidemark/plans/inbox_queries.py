"""Queries over lake-side changes and two-way sync, each with its SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.render import render_row
from tidemark.operators import collapse, conflict, inbox, merge, reverse
from tidemark.plans import fixtures as fx
from tidemark.session import local_rows, new_work_folder
from tidemark.sources.inbox_store import Inbox
from tidemark.sources.keyed import KeyedTable

SINCE = 11000  # 2000-02-13 as a day number
KEY, SEQ = ["c_custkey"], ["seq"]


def change_feed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.changes_since(fx.inbox_changes(spark, sf_dir), SINCE)


def _net(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return inbox.net_change(fx.inbox_changes(spark, sf_dir), ["l_orderkey"], fx.CHANGE_ORDER, **options)


def net_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir)


def net_change_preimages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir, preimage_deletes=True)


def change_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.missing_keys(fx.inbox_changes(spark, sf_dir), ["l_orderkey"])


def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.apply_changes(fx.order_target(spark, sf_dir), _net(spark, sf_dir), ["l_orderkey"])


def merge_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stored table, rewriting touched buckets."""
    target = fx.order_target(spark, sf_dir)
    table = KeyedTable(
        new_work_folder(spark, "merge"),
        "l_orderkey BIGINT, status STRING, l_extendedprice DECIMAL(18,2), l_partkey BIGINT",
        ("l_orderkey",),
        buckets=8,
    )
    table.merge(target.withColumn("op", F.lit(merge.UPSERT)))
    table.merge(_net(spark, sf_dir), source="inbox", source_version=SINCE)
    return table.read(spark)


def apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and deletes that merges into two stored tables applied, counted while they were staged."""
    accounts = fx.account_rows(spark, sf_dir)
    diff = merge.snapshot_diff(accounts, fx.second_snapshot(spark, sf_dir), KEY, version=1)
    orders = KeyedTable(
        new_work_folder(spark, "orders"),
        "l_orderkey BIGINT, status STRING, l_extendedprice DECIMAL(18,2), l_partkey BIGINT",
        ("l_orderkey",),
        buckets=8,
    )
    customers = KeyedTable(
        new_work_folder(spark, "customers"),
        "c_custkey BIGINT, c_mktsegment STRING, c_acctbal DECIMAL(18,2)",
        ("c_custkey",),
        buckets=8,
    )
    upsert = F.lit(merge.UPSERT).alias("op")
    steps = [
        ("orders", orders, fx.order_target(spark, sf_dir).select("*", upsert)),
        ("customer", customers, accounts.select("*", upsert)),
        ("orders", orders, _net(spark, sf_dir)),
        ("customer", customers, inbox.net_change(diff, KEY, KEY)),
    ]
    done = [(name, table.merge_counted(changes)) for name, table, changes in steps]
    rows = [(name, c["version"], c["upserts"], c["deletes"]) for name, c in done]
    return local_rows(spark, rows, "table STRING, version BIGINT, upserts BIGINT, deletes BIGINT")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = fx.account_rows(spark, sf_dir), fx.second_snapshot(spark, sf_dir)
    return merge.snapshot_diff(old, new, KEY, version=1)


def inbox_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = fx.account_rows(spark, sf_dir), F.col("c_custkey")
    box = Inbox(new_work_folder(spark, "inbox"), ("c_custkey",))
    box.create(spark, "c_custkey BIGINT, c_mktsegment STRING, c_acctbal DECIMAL(18,2)")
    box.insert(rows)
    box.delete(spark, key % 7 == 0)
    box.update(spark, key % 11 == 0, {"c_acctbal": F.col("c_acctbal") + 1})
    box.insert(rows.filter(key % 13 == 0).withColumn("c_custkey", key + 1_000_000))
    return box.changes(spark)


def reverse_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    late = F.timestamp_add("MICROSECOND", F.col("o_orderkey") * 1001, F.col("o_orderdate").cast("timestamp"))
    return render_row(
        o.select(
            "o_orderkey",
            F.col("o_totalprice").cast("decimal(18,4)").alias("price"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("local_time"),
            late.alias("instant"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.encode("o_orderpriority", "UTF-8"), F.unhex(F.lit("FF"))))
            .otherwise(F.encode("o_orderpriority", "UTF-8"))
            .alias("bytes"),
        )
    )


def conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = collapse.latest_per_key(fx.lake_changes(spark, sf_dir, unversioned=True), KEY, SEQ)
    settled = conflict.resolve(fx.account_target(spark, sf_dir), lake, KEY, conflict.LAST_WRITE_WINS)
    return settled.select(
        "c_custkey", "winner", "error", "reason",
        F.when(F.col("winner") == "lakehouse", F.col("lake_row.c_acctbal"))
        .otherwise(F.col("pg_row.c_acctbal")).alias("c_acctbal"),
    )


def conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = collapse.latest_per_key(fx.lake_changes(spark, sf_dir), KEY, SEQ)
    rules = {
        "c_acctbal": lambda pg, lk: F.greatest(pg, lk),
        "version": conflict.LAKEHOUSE,
    }
    settled = conflict.resolve(
        fx.account_target(spark, sf_dir), lake, KEY, conflict.MERGE, rules=rules
    )
    return settled.select("c_custkey", "winner", "merged.*")


def _greater_balance(pg: pa.RecordBatch, lake: pa.RecordBatch) -> pa.Table:
    balance = pc.max_element_wise(pg["c_acctbal"], lake["c_acctbal"])
    return pa.table({"c_custkey": pg["c_custkey"], "c_acctbal": balance, "version": lake["version"]})


def conflict_merge_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of ``conflict_merge`` by a Python function of two Arrow batches."""
    lake = collapse.latest_per_key(fx.lake_changes(spark, sf_dir), KEY, SEQ)
    schema = "c_custkey BIGINT, c_acctbal DECIMAL(18,2), version BIGINT"
    merged = conflict.merge_with_arrow(fx.account_target(spark, sf_dir), lake, KEY, _greater_balance, schema)
    return merged.withColumn("winner", F.lit(conflict.POSTGRES))


def conflict_merge_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a Python function of two rows."""

    def pick(pg: dict, lake: dict) -> dict:
        return {
            "c_custkey": pg["c_custkey"],
            "c_acctbal": max(pg["c_acctbal"], lake["c_acctbal"]),
            "version": lake["version"],
        }

    lake = collapse.latest_per_key(fx.lake_changes(spark, sf_dir), KEY, SEQ)
    schema = "c_custkey BIGINT, c_acctbal DECIMAL(18,2), version BIGINT"
    merged = conflict.merge_with_python(fx.account_target(spark, sf_dir), lake, KEY, pick, schema)
    return merged.withColumn("winner", F.lit(conflict.POSTGRES))


def _decide(spark, sf_dir, policy, sot, unversioned=False) -> DataFrame:
    return reverse.decide(
        fx.lake_changes(spark, sf_dir, unversioned),
        fx.account_target(spark, sf_dir),
        fx.account_ledger(spark, sf_dir),
        KEY, SEQ, "version", policy, sot,
    )


def _decision(policy: str, sot: str, unversioned: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        decided = _decide(spark, sf_dir, policy, sot, unversioned)
        return decided.select("c_custkey", "seq", "action", "reason")

    return query


def reverse_sync_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of all changes on one key, scanned in ranges."""
    decided = reverse.decide(
        fx.hot_changes(spark, sf_dir),
        fx.account_target(spark, sf_dir),
        fx.account_ledger(spark, sf_dir),
        ["c_custkey"],
        ["at", "seq"],
        "version",
        "last_write_wins",
        "lakehouse",
    )
    return decided.select("c_custkey", "seq", "action", "reason")


def apply_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse.report(_decide(spark, sf_dir, conflict.LAST_WRITE_WINS, conflict.POSTGRES))


def reverse_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decide(spark, sf_dir, conflict.LAST_WRITE_WINS, conflict.POSTGRES)
    return reverse.apply_decided(fx.account_target(spark, sf_dir), decided, KEY, SEQ)


def reverse_apply_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decide(spark, sf_dir, conflict.MERGE, conflict.POSTGRES)
    rules = {"c_acctbal": "greatest", "version": conflict.LAKEHOUSE}
    return reverse.apply_decided(fx.account_target(spark, sf_dir), decided, KEY, SEQ, rules)


def ledger_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decide(spark, sf_dir, conflict.SOURCE_OF_TRUTH, conflict.LAKEHOUSE, unversioned=True)
    return reverse.advance_ledger(fx.account_ledger(spark, sf_dir), decided, KEY, SEQ, "version")


# Fixture C, and its net change, as SQL.
CHANGES_SQL = """
WITH ch AS (
  SELECT CASE WHEN l_partkey % 101 <> 0 THEN l_orderkey END AS l_orderkey,
         l_linenumber, l_partkey, l_suppkey,
         CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS _commit_version,
         CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'update_preimage'
              WHEN l_returnflag = 'A' THEN 'insert' WHEN l_returnflag = 'N' THEN 'update_postimage'
              ELSE 'delete' END AS _change_type
  FROM lineitem)
"""
NET_SQL = CHANGES_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY _commit_version DESC,
     CASE WHEN _change_type = 'delete' THEN 0 ELSE 1 END DESC, l_linenumber DESC, l_partkey DESC,
     l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM ch WHERE l_orderkey IS NOT NULL AND _change_type <> 'update_preimage'),
net AS (
  SELECT l_orderkey, CASE WHEN _change_type = 'delete' THEN 'delete' ELSE 'upsert' END AS op,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM ranked WHERE rn = 1)
"""
MERGE_SQL = NET_SQL + """
, tgt AS (SELECT o_orderkey AS l_orderkey, o_orderstatus AS status,
                 CAST(o_totalprice AS DECIMAL(18,2)) AS l_extendedprice FROM orders)
SELECT coalesce(t.l_orderkey, n.l_orderkey) AS l_orderkey, t.status,
       CASE WHEN n.op = 'upsert' THEN n.l_extendedprice ELSE t.l_extendedprice END AS l_extendedprice,
       CASE WHEN n.op = 'upsert' THEN n.l_partkey END AS l_partkey
FROM tgt t FULL OUTER JOIN net n ON t.l_orderkey = n.l_orderkey
WHERE n.op IS NULL OR n.op = 'upsert'
"""


def fold_sql(
    policy: str, sot: str, unversioned: bool, key: str = "o_custkey", order: str = "o_orderkey"
) -> str:
    """Fixture D judged change by change, in the order of arrival."""
    version = "epoch_us(o_orderdate)"
    if unversioned:
        version = f"CASE WHEN o_orderkey % 50 <> 0 THEN {version} END"
    lake = "true" if sot == "lakehouse" else "false"
    conflict_action = {
        "last_write_wins": f"""CASE WHEN p IS NULL OR v IS NULL THEN 'error' WHEN v > p THEN 'apply'
                               WHEN v = p AND {lake} THEN 'apply' ELSE 'skip_pg_wins' END""",
        "source_of_truth": f"CASE WHEN {lake} THEN 'apply' ELSE 'skip_pg_wins' END",
        "merge": "'apply_merge'",
        "error": "'error'",
    }[policy]
    conflict_reason = {
        "last_write_wins": f"""CASE
            WHEN p IS NULL OR v IS NULL THEN 'last_write_wins requires a version on both rows; refusing to guess'
            WHEN v = p THEN 'equal versions (' || v || '); broke tie via source_of_truth={sot}'
            WHEN v > p THEN 'last_write_wins: lakehouse version ' || v || ' > ' || p
            ELSE 'last_write_wins: postgres version ' || p || ' > ' || v END""",
        "source_of_truth": f"'source_of_truth={sot} wins unconditionally'",
        "merge": "'column-level merge via merge_fn'",
        "error": "'conflict on key ' || k || ' and policy=error; manual resolution required'",
    }[policy]
    return f"""
WITH RECURSIVE ch AS (
  SELECT {key} AS k, o_orderkey AS seq, {version} AS v, CAST(o_totalprice AS DECIMAL(18,2)) AS bal,
         row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i
  FROM orders),
st AS (
  SELECT k, CAST(0 AS BIGINT) AS i, c.c_custkey IS NOT NULL AND k % 3 <> 0 AS ex,
         CASE WHEN c.c_custkey IS NOT NULL AND k % 3 <> 0 THEN {fx.ROW_VERSION} END AS p,
         CASE WHEN c.c_custkey IS NOT NULL AND k % 5 = 0 THEN {fx.LEDGER_VERSION} END AS l,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS v, CAST(NULL AS DECIMAL(18,2)) AS bal,
         CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT k FROM ch) LEFT JOIN customer c ON c.c_custkey = k
  UNION ALL
  SELECT k, i, ex OR action LIKE 'apply%', CASE WHEN action LIKE 'apply%' THEN v ELSE p END,
         CASE WHEN action LIKE 'apply%' THEN v ELSE l END, seq, v, bal, action, reason
  FROM (
    SELECT *,
           CASE WHEN v <= l THEN 'skip_duplicate' WHEN NOT ex THEN 'apply'
                ELSE {conflict_action} END AS action,
           CASE WHEN v <= l THEN 'lake version ' || v || ' <= last applied ' || l
                WHEN NOT ex THEN 'no existing Postgres row; inserting'
                ELSE {conflict_reason} END AS reason
    FROM (SELECT st.k, ch.i, st.ex, st.p, st.l, ch.seq, ch.v, ch.bal
          FROM st JOIN ch ON ch.k = st.k AND ch.i = st.i + 1))),
decided AS (SELECT * FROM st WHERE i > 0)
"""


HOT_SQL = fold_sql(
    "last_write_wins",
    "lakehouse",
    True,
    key="CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE o_custkey END",
    order="""CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE)
             ELSE (o_orderkey % 100) / 4 END NULLS FIRST, o_orderkey""",
)

_VARIANTS = {
    "reverse_sync": ("last_write_wins", "postgres", False),
    "reverse_sync_tie_lake": ("last_write_wins", "lakehouse", True),
    "reverse_sync_unversioned": ("last_write_wins", "postgres", True),
    "reverse_sync_lake_truth": ("source_of_truth", "lakehouse", True),
    "reverse_sync_pg_truth": ("source_of_truth", "postgres", True),
    "reverse_sync_merge": ("merge", "postgres", True),
    "reverse_sync_error": ("error", "postgres", True),
}

QUERIES = {
    "change_feed_read": change_feed_read,
    "net_change": net_change,
    "net_change_preimages": net_change_preimages,
    "change_missing_key": change_missing_key,
    "merge_apply": merge_apply,
    "merge_store": merge_store,
    "apply_counts": apply_counts,
    "snapshot_diff": snapshot_diff,
    "inbox_write": inbox_write,
    "reverse_render": reverse_render,
    "conflict_resolve": conflict_resolve,
    "conflict_merge": conflict_merge,
    "conflict_merge_arrow": conflict_merge_arrow,
    "conflict_merge_python": conflict_merge_python,
    **{name: _decision(*v) for name, v in _VARIANTS.items()},
    "reverse_sync_hot": reverse_sync_hot,
    "apply_report": apply_report,
    "reverse_apply": reverse_apply,
    "reverse_apply_merge": reverse_apply_merge,
    "ledger_advance": ledger_advance,
}

_ACCOUNTS_SQL = """
WITH r AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer)
"""

_PAIRS_SQL = """
WITH lk AS (
  SELECT o_custkey AS k, o_orderkey AS seq, CAST(o_totalprice AS DECIMAL(18,2)) AS bal, {version} AS v,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders),
pr AS (
  SELECT k, v, bal, CAST(c_acctbal AS DECIMAL(18,2)) AS pg_bal, {p} AS p
  FROM lk JOIN customer ON c_custkey = k WHERE rn = 1 AND k % 3 <> 0)
"""

_MERGED_SQL = _PAIRS_SQL.format(version="epoch_us(o_orderdate)", p=fx.ROW_VERSION) + """
SELECT k AS c_custkey, 'postgres' AS winner, greatest(pg_bal, bal) AS c_acctbal, v AS version FROM pr
"""

ORACLE = {
    "change_feed_read": CHANGES_SQL + f"SELECT * FROM ch WHERE _commit_version > {SINCE}",
    "net_change": NET_SQL + "SELECT * FROM net",
    "net_change_preimages": CHANGES_SQL + """
, kinds AS (SELECT *, CASE WHEN _change_type IN ('delete', 'update_preimage') THEN 0 ELSE 1 END AS up
            FROM ch WHERE l_orderkey IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY _commit_version DESC, up DESC,
     l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM kinds)
SELECT l_orderkey, CASE up WHEN 0 THEN 'delete' ELSE 'upsert' END AS op, l_linenumber, l_partkey,
       l_suppkey, l_quantity, l_extendedprice
FROM ranked WHERE rn = 1
""",
    "change_missing_key": CHANGES_SQL + "SELECT * FROM ch WHERE l_orderkey IS NULL",
    "merge_apply": MERGE_SQL,
    "merge_store": MERGE_SQL,
    "apply_counts": NET_SQL + """
SELECT 'orders' AS "table", CAST(0 AS BIGINT) AS version, count(*) AS upserts, CAST(0 AS BIGINT) AS deletes FROM orders
UNION ALL SELECT 'customer', 0, count(*), 0 FROM customer
UNION ALL SELECT 'orders', 1, count(*) FILTER (op = 'upsert'), count(*) FILTER (op = 'delete') FROM net
UNION ALL SELECT 'customer', 1,
  count(*) FILTER (c_custkey % 13 = 0) + count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 11 = 0),
  count(*) FILTER (c_custkey % 7 = 0) FROM customer
""",
    "snapshot_diff": _ACCOUNTS_SQL + """
, later AS (
  SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
  FROM r WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_acctbal FROM r WHERE c_custkey % 13 = 0),
out AS (
  SELECT r.*, 'delete' AS _change_type FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM later)
  UNION ALL SELECT l.*, 'insert' FROM later l WHERE c_custkey NOT IN (SELECT c_custkey FROM r)
  UNION ALL SELECT r.*, 'update_preimage' FROM r JOIN later l USING (c_custkey)
    WHERE (r.c_mktsegment, r.c_acctbal) IS DISTINCT FROM (l.c_mktsegment, l.c_acctbal)
  UNION ALL SELECT l.*, 'update_postimage' FROM r JOIN later l USING (c_custkey)
    WHERE (r.c_mktsegment, r.c_acctbal) IS DISTINCT FROM (l.c_mktsegment, l.c_acctbal))
SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, _change_type,
       CAST(1 AS BIGINT) AS _commit_version
FROM out
""",
    "inbox_write": _ACCOUNTS_SQL + """
, out AS (
  SELECT *, 'insert' AS _change_type, 1 AS v FROM r
  UNION ALL SELECT *, 'delete', 2 FROM r WHERE c_custkey % 7 = 0
  UNION ALL SELECT *, 'update_preimage', 3 FROM r WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal + 1, 'update_postimage', 3 FROM r
            WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_acctbal, 'insert', 4 FROM r WHERE c_custkey % 13 = 0)
SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, _change_type,
       CAST(v AS BIGINT) AS _commit_version
FROM out
""",
    "reverse_render": """
WITH t AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) + to_microseconds(o_orderkey * 1001) AS late FROM orders)
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) AS price,
       strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS local_time,
       strftime(late, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN epoch_us(late) % 1000000 = 0 THEN '' ELSE strftime(late, '.%f') END || '+00:00' AS instant,
       o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(65533) ELSE '' END AS bytes
FROM t
""",
    "conflict_resolve": _PAIRS_SQL.format(
        version="CASE WHEN o_orderkey % 50 <> 0 THEN epoch_us(o_orderdate) END", p=fx.ROW_VERSION
    ) + """
SELECT k AS c_custkey,
       CASE WHEN v IS NULL THEN NULL WHEN v > p THEN 'lakehouse' ELSE 'postgres' END AS winner,
       v IS NULL AS error,
       CASE WHEN v IS NULL THEN 'last_write_wins requires a version on both rows; refusing to guess'
            WHEN v = p THEN 'equal versions (' || p || '); broke tie via source_of_truth=postgres'
            WHEN v > p THEN 'last_write_wins: lakehouse version ' || v || ' > ' || p
            ELSE 'last_write_wins: postgres version ' || p || ' > ' || v END AS reason,
       CASE WHEN v > p THEN bal ELSE pg_bal END AS c_acctbal
FROM pr
""",
    "conflict_merge": _MERGED_SQL,
    "conflict_merge_arrow": _MERGED_SQL,
    "conflict_merge_python": _MERGED_SQL,
    **{
        name: fold_sql(*v) + "SELECT k AS c_custkey, seq, action, reason FROM decided"
        for name, v in _VARIANTS.items()
    },
    "reverse_sync_hot": HOT_SQL + "SELECT k AS c_custkey, seq, action, reason FROM decided",
    "apply_report": fold_sql("last_write_wins", "postgres", False) + """
SELECT action, count(*) AS changes, count(*) FILTER (action LIKE 'apply%') AS applied FROM decided GROUP BY action
""",
    "reverse_apply": fold_sql("last_write_wins", "postgres", False) + f"""
, last AS (SELECT k, max(seq) AS seq FROM decided WHERE action LIKE 'apply%' GROUP BY k),
app AS (SELECT d.k, d.bal, d.v FROM decided d JOIN last USING (k, seq)),
tgt AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(c_custkey, k) AS c_custkey, c_mktsegment,
       CASE WHEN k IS NULL THEN tgt.bal ELSE app.bal END AS c_acctbal,
       CASE WHEN k IS NULL THEN {fx.ROW_VERSION} ELSE v END AS version
FROM tgt FULL OUTER JOIN app ON c_custkey = k
""",
    "reverse_apply_merge": fold_sql("merge", "postgres", False) + f"""
, app AS (SELECT k, max(bal) AS bal, arg_max(v, seq) AS v FROM decided WHERE action LIKE 'apply%' GROUP BY k),
tgt AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(c_custkey, k) AS c_custkey, c_mktsegment,
       CASE WHEN k IS NULL THEN tgt.bal WHEN c_custkey IS NULL THEN app.bal ELSE greatest(tgt.bal, app.bal) END AS c_acctbal,
       CASE WHEN k IS NULL THEN {fx.ROW_VERSION} ELSE v END AS version
FROM tgt FULL OUTER JOIN app ON c_custkey = k
""",
    "ledger_advance": fold_sql("source_of_truth", "lakehouse", True) + f"""
, last AS (SELECT k, max(seq) AS seq FROM decided WHERE action LIKE 'apply%' GROUP BY k),
app AS (SELECT d.k, d.v FROM decided d JOIN last USING (k, seq)),
led AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN {fx.LEDGER_VERSION} ELSE v END AS lake_version
FROM led FULL OUTER JOIN app ON c_custkey = k
""",
}
