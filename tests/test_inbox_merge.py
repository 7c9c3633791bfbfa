import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inbox, inventory, merge, metrics
from tidemark.sources import cdc

CHANGE = "k BIGINT, a BIGINT, _commit_version BIGINT, _change_type STRING"
RANK = {"delete": 0}


def net(changes, preimages=False):
    """The last change of each key in commit order."""
    last = {}
    for k, a, version, kind in changes:
        if k is None or (kind == "update_preimage" and not preimages):
            continue
        removes = kind == "delete" or kind == "update_preimage"
        order = (version, 0 if removes else 1, a)
        if k not in last or order > last[k][0]:
            last[k] = (order, ("delete" if removes else "upsert", a))
    return {k: v for k, (_, v) in last.items()}


@pytest.mark.parametrize("preimages", [False, True])
def test_net_change_fold(spark, preimages):
    rng = random.Random(4)
    kinds = ["insert", "update_postimage", "update_preimage", "delete"]
    changes = [
        (None if rng.random() < 0.02 else rng.randrange(80), rng.randrange(10_000), rng.randrange(30), rng.choice(kinds))
        for _ in range(2000)
    ]
    df = spark.createDataFrame(changes, CHANGE).repartition(7)
    got = inbox.net_change(df, ["k"], preimage_deletes=preimages)
    assert {r["k"]: (r["op"], r["a"]) for r in got.collect()} == net(changes, preimages)
    assert inbox.missing_keys(df, ["k"]).count() == sum(c[0] is None for c in changes)


def test_missing_key_can_fail_the_job(spark):
    df = spark.createDataFrame([(None, 1, 1, "insert")], CHANGE)
    assert inbox.net_change(df, ["k"]).count() == 0
    with pytest.raises(Exception, match="change without a value of its key k"):
        inbox.net_change(df, ["k"], on_missing_key="fail").collect()
    with pytest.raises(ValueError):
        inbox.net_change(df, ["k"], on_missing_key="guess")


def test_insert_update_delete_in_a_row_is_one_delete(spark):
    rows = [(3, 1, 1, "insert"), (3, 1, 2, "update_preimage"), (3, 2, 2, "update_postimage"), (3, 2, 3, "delete")]
    df = spark.createDataFrame(rows, CHANGE)
    assert [tuple(r) for r in inbox.net_change(df, ["k"]).collect()] == [(3, "delete", 2)]
    assert inbox.changes_since(df, 2).count() == 1 and inbox.changes_since(df).count() == 4


def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k BIGINT, name STRING, n INT")


def test_absent_column_keeps_and_null_overwrites(spark):
    changes = spark.createDataFrame(
        [(1, None, "upsert", "x"), (2, 5, "delete", "x"), (9, 90, "upsert", "x")], "k INT, n BIGINT, op STRING, extra STRING"
    )
    rows = merge.apply_changes(target(spark), changes, ["k"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", None), (3, "c", 30), (9, None, 90)]
    assert rows.schema["n"].dataType.typeName() == "integer"


def test_key_only_change_inserts_if_absent(spark):
    changes = spark.createDataFrame([(1, "upsert"), (7, "upsert"), (8, "delete")], "k BIGINT, op STRING")
    rows = merge.apply_changes(target(spark), changes, ["k"])
    assert sorted((r["k"], r["name"]) for r in rows.collect()) == [(1, "a"), (2, "b"), (3, "c"), (7, None)]


def test_diff_leads_from_one_snapshot_to_the_next(spark):
    rng = random.Random(8)
    old = [(k, rng.choice(["x", "y", None]), k) for k in range(200) if rng.random() < 0.7]
    new = [(k, rng.choice(["x", "y", None]), k) for k in range(200) if rng.random() < 0.7]
    schema = "k BIGINT, name STRING, n INT"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    diff = merge.snapshot_diff(a, b, ["k"], version=3)
    assert {r[0] for r in diff.select("_commit_version").distinct().collect()} == {3}
    after = merge.apply_changes(a, inbox.net_change(diff, ["k"]), ["k"])
    assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert merge.snapshot_diff(a, a, ["k"], 1).count() == 0


def test_statements(spark):
    rows = target(spark)
    up = inbox.update_rows(rows, F.col("k") >= 2, {"n": F.col("n") * 2})
    assert sorted((r["k"], r["n"], r["_change_type"]) for r in up.collect()) == [
        (2, 20, "update_preimage"), (2, 40, "update_postimage"), (3, 30, "update_preimage"), (3, 60, "update_postimage"),
    ]
    assert inbox.delete_rows(rows, F.col("k") == 1).first()["_change_type"] == "delete"
    with pytest.raises(ValueError):
        inbox.update_rows(rows, F.lit(True), {"nope": F.lit(1)})


def test_inventory(spark):
    keys = [
        "lake/orders/_delta_log/0.json", "lake/orders/_delta_log/1.json", "lake/orders/part-0.parquet",
        "deep/a/b/_delta_log/0.json", "solo/_delta_log/0.json", "lake/orders_inbox/_delta_log/0.json",
        "/_delta_log/0.json", "_inbox/_delta_log/0.json", "plain/file",
    ]
    objects = spark.createDataFrame([(k,) for k in keys], "key STRING")
    named = {tuple(r) for r in inventory.named(inventory.table_locations(objects)).collect()}
    assert named == {
        ("proj_lake", "orders", "lake/orders"), ("proj_deep", "a_b", "deep/a/b"), ("proj_solo", "solo", "solo"),
        ("proj_lake", "orders_inbox", "lake/orders_inbox"), ("proj__inbox", "_inbox", "_inbox"),
    }
    assert {tuple(r) for r in inventory.inbox_locations(objects).collect()} == {("lake/orders_inbox", "lake", "orders")}
    registered = spark.createDataFrame(
        [("proj_lake", "orders", "lake/orders"), ("proj_lake", "gone", "lake/gone"), ("proj_old", "t", "old/t"),
         ("proj_deep", "a_b", "deep/a/b")],
        "schema STRING, table STRING, location STRING",
    )
    steps = {(r["action"], r["schema"], r["table"]) for r in inventory.reconcile(objects, registered).collect()}
    assert steps == {
        ("register", "proj_solo", "solo"), ("register", "proj_lake", "orders_inbox"), ("register", "proj__inbox", "_inbox"),
        ("unregister", "proj_lake", "gone"), ("unregister", "proj_old", "t"), ("drop_schema", "proj_old", None),
    }


def test_metrics(spark):
    topic = "cdc.p.proj_p.t"
    ledger = spark.sql(f"""SELECT * FROM VALUES
        (0L, '{topic}', 0, 9L, 10L, TIMESTAMP'2024-01-01 00:00:10'), (1L, '{topic}', 0, 19L, 8L, TIMESTAMP'2024-01-01 00:00:50'),
        (1L, '{topic}', 1, 3L, 0L, TIMESTAMP'2024-01-01 00:01:00') AS t(version, topic, partition, max_offset, rows, commit_ts)""")
    assert tuple(metrics.counters(ledger).first()) == ("p", "t", 18, 2)
    rates = sorted((r["rows"], round(r["rows_per_second"], 3)) for r in metrics.rate(ledger).collect())
    assert rates == [(0, 0.0), (18, 0.3)]
    ends = spark.createDataFrame([("g", topic, 0, 25), ("g", topic, 1, 3), ("g", topic, 2, 4)], "grp STRING, topic STRING, partition INT, end_offset BIGINT")
    marks = spark.createDataFrame([(topic, 0, 19), (topic, 1, 3)], "topic STRING, partition INT, max_offset BIGINT")
    assert tuple(metrics.lag(ends, marks, ["grp"]).first()) == ("g", 6 + 0 + 5)


def test_rate_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entries = spark.sql("""SELECT * FROM VALUES
        (0L, 'cdc.p.proj_p.t', 0, 9L, 60L, TIMESTAMP'2024-01-01 00:00:10'),
        (1L, 'cdc.p.proj_p.t', 0, 19L, 30L, TIMESTAMP'2024-01-01 00:01:50') AS t(version, topic, partition, max_offset, rows, commit_ts)""")
    entries.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(entries.schema).parquet(path)
    query = (
        metrics.rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["rows_per_second"] for r in spark.table("rates").collect()) == [0.5, 1.0]


def test_snapshot_rows(spark):
    rows = spark.sql("SELECT 1L id, CAST(19.9 AS DECIMAL(10,2)) amount, CAST(NULL AS STRING) note")
    row = cdc.snapshot_rows(rows, "p", "t", 5).first()
    assert (row["_op"], row["data"]) == ("r", '{"id":1,"amount":"19.90","note":null}')
