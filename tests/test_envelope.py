import json

import pytest

from pyspark.sql import functions as F
from tidemark.functions.json_text import json_or_text
from tidemark.operators import collapse, envelope, infer

SCHEMA = "topic STRING, partition INT, offset BIGINT, value STRING"
TOPIC = "cdc.p.proj_p.t"


def messages(spark, *values, topic=TOPIC):
    rows = [(topic, 0, i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def normalized(spark, *values):
    rows = envelope.normalize(messages(spark, *values)).orderBy("offset").collect()
    return rows if len(rows) > 1 else rows[0]


@pytest.mark.parametrize(
    "topic, project, table",
    [
        ("cdc.analytics.proj_analytics.events", "analytics", "events"),
        ("cdc.my_proj.proj_my_proj.orders", "my_proj", "orders"),
        ("cdc.a.proj_a.Mixed_Case9", "a", "Mixed_Case9"),
        ("cdc.analytics.events", None, None),
        ("other.analytics.proj_analytics.events", None, None),
        ("cdc.a.proj_b.events", None, None),
        ("cdc.A.proj_A.events", None, None),
        ("cdc.a.proj_a.events.more", None, None),
    ],
)
def test_route(spark, topic, project, table):
    row = envelope.route(messages(spark, "{}", topic=topic)).first()
    assert (row["project"], row["table"]) == (project, table)


def test_prefix_is_a_parameter(spark):
    row = envelope.route(messages(spark, "{}", topic="x.y.a.proj_a.t"), prefix="x.y").first()
    assert (row["project"], row["table"]) == ("a", "t")


def test_location(spark):
    df = spark.range(1).select(
        envelope.storage_location(F.lit("analytics"), F.lit("events")).alias("a"),
        envelope.storage_location(F.lit("analytics"), F.lit("events"), bucket="lake").alias("b"),
    )
    assert tuple(df.first()) == ("s3://warehouse/analytics/events", "s3://lake/analytics/events")


def test_insert(spark):
    row = normalized(spark, {"id": 1, "name": "a", "__op": "c", "__ts_ms": 1700, "__deleted": "false"})
    assert (row["_op"], row["_ts_ms"], row["_deleted"]) == ("c", 1700, False)
    assert row["data"] == '{"id":1,"name":"a"}'


def test_delete_and_defaults(spark):
    gone, snapshot, empty, null_op, upper = normalized(
        spark,
        {"id": 5, "name": None, "__op": "d", "__ts_ms": 1800, "__deleted": "true"},
        {"id": 9, "__deleted": "false"},
        {"id": 9, "__op": ""},
        {"id": 9, "__op": None, "__ts_ms": None},
        {"id": 9, "__deleted": "TRUE"},
    )
    assert gone["_deleted"] and gone["_op"] == "d" and json.loads(gone["data"]) == {"id": 5, "name": None}
    assert (snapshot["_op"], snapshot["_ts_ms"], snapshot["_deleted"]) == ("r", None, False)
    assert empty["_op"] == "r" and null_op["_op"] == "r"
    assert upper["_deleted"]


def test_reasons(spark):
    rows = normalized(spark, None, "", "null", {"__op": "c"}, "{broken", "[1]", {"id": 1})
    reasons = [r["reason"] for r in rows]
    assert reasons == ["tombstone"] * 3 + ["no_data_columns", "invalid_json", "invalid_json", None]
    bad = messages(spark, None, {"id": 1}, topic="cdc.a.proj_b.t")
    assert [r["reason"] for r in envelope.normalize(bad).collect()] == ["bad_topic"] * 2
    assert envelope.rejects(messages(spark, None, "[1]")).count() == 1


def test_all_paths_accept_the_same_texts(spark):
    odd = [
        '{"a":1}x', '{"a":1,"a":2}', '{"a":NaN}', '{"a":Infinity}', "{'a':1}", '{"a":1e400}', '{"a":0012}', '{"a":1',
        '{"a":{"x":1,"x":2}}', '{"__op":"c","__op":"d","a":1}', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1},{"end":1}]', '{"a":1},{"b":2}',
        '{"a":"\\u00e9"}', "[1]", "5", '"text"', "{}", '{"__op":5,"a":[1,{"c":1.10}],"__deleted":true,"__ts_ms":"12"}',
    ]
    sent = messages(spark, *odd)
    rows = envelope.normalize(sent).collect()
    accepted = {r["offset"] for r in rows if r["reason"] is None}
    assert {r["offset"] for r in envelope.feed_rows(sent).collect()} == accepted
    assert {r["offset"] for r in envelope.normalize_typed(sent, "a STRING").collect()} == accepted
    assert {r["offset"] for r in envelope.rejects(sent).collect()} == set(range(len(odd))) - accepted
    reasons = {r["offset"]: r["reason"] for r in envelope.rejects(sent).collect()}
    assert {r["offset"]: r["reason"] for r in rows if r["reason"]} == reasons
    assert all(r["data"] for r in rows if r["reason"] is None)
    assert {odd[o] for o in accepted} == {'{"a":1e400}', '{"a":"\\u00e9"}', odd[-1]}
    assert {odd[o] for o, why in reasons.items() if why == "no_data_columns"} == {"{}"}


def test_both_readers_agree(spark):
    values = [{"id": 1, "doc": {"b": 1, "a": [2]}, "__op": "u", "__ts_ms": 5}, {"__op": "c"}, None, "{x"]
    raw = envelope.decode(envelope.feed_rows(messages(spark, *values)), "id BIGINT, doc STRING")
    typed = envelope.normalize_typed(messages(spark, *values), "id BIGINT, doc STRING")
    shown = ["id", "_op", "_ts_ms", "_deleted", json_or_text(F.col("doc")).alias("doc")]
    assert raw.select(*shown).collect() == typed.select(*shown).collect()
    assert raw.count() == 1


def test_nested_values_become_stable_json(spark):
    texts = ['{"b":1,"a":2}', "[1, 2, 3]", "hi", "5", None, '{"hello": "world"}', "{not json"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r[0] for r in df.orderBy("i").select(json_or_text(F.col("t"))).collect()]
    assert got == ['{"a":2,"b":1}', "[1,2,3]", "hi", "5", None, '{"hello":"world"}', "{not json"]


def test_unwrap(spark):
    events = [
        {"before": None, "after": {"id": 1, "v": 2}, "op": "c", "ts_ms": 10},
        {"before": {"id": 1, "v": 2}, "after": None, "op": "d", "ts_ms": 11},
        {"before": {"id": 1, "v": 2}, "after": {"id": 1, "v": 3}, "op": "u", "ts_ms": 12},
        None,
    ]
    rows = envelope.normalize(envelope.unwrap(messages(spark, *events))).orderBy("offset").collect()
    assert [r["data"] for r in rows] == ['{"id":1,"v":2}', '{"id":1,"v":2}', '{"id":1,"v":3}', None]
    assert [r["_deleted"] for r in rows] == [False, True, False, None]
    assert [r["_op"] for r in rows[:3]] == ["c", "d", "u"] and rows[3]["reason"] == "tombstone"


def test_current_state_orders_by_time_not_arrival(spark):
    values = [
        {"id": 1, "v": "new", "__op": "u", "__ts_ms": 9},
        {"id": 1, "v": "late", "__op": "u", "__ts_ms": 3},
        {"id": 2, "v": "x", "__op": "c", "__ts_ms": 1},
        {"id": 2, "v": "x", "__op": "d", "__ts_ms": 2, "__deleted": "true"},
        {"id": 3, "v": "first", "__op": "c", "__ts_ms": 4},
        {"id": 3, "v": "tie", "__op": "u", "__ts_ms": 4},
    ]
    rows = envelope.normalize_typed(messages(spark, *values), "id BIGINT, v STRING")
    live = collapse.current_state(rows, ["id"])
    assert sorted((r["id"], r["v"]) for r in live.collect()) == [(1, "new"), (3, "tie")]
    ranked = collapse.rank_changes(rows, ["id"]).filter("NOT _deleted")
    assert sorted((r["id"], r["v"]) for r in ranked.collect()) == [(1, "new"), (3, "tie")]


def test_infer_union_drops_null_columns(spark):
    rows = envelope.feed_rows(
        messages(
            spark, {"id": 1, "note": None, "some": None}, {"id": 2, "extra": "x", "note": None, "some": "y"},
            {"id": 3, "doc": {"a": 1}, "mix": 1}, {"id": 4, "mix": "t"},
        )
    )
    got = {r["name"]: (r["type"], r["nested"], r["mixed"]) for r in infer.infer_columns(rows).collect()}
    assert got == {
        "id": ("BIGINT", False, False),
        "extra": ("STRING", False, False),
        "some": ("STRING", False, False),
        "doc": ("STRING", True, False),
        "mix": ("STRING", False, True),
    }


def test_frames_union_and_drop_null_columns(spark):
    a = spark.createDataFrame([(1, None)], "id INT, note STRING")
    b = spark.createDataFrame([(2, "x")], "id INT, extra STRING")
    whole = infer.union_by_name([a, b])
    assert sorted(tuple(r) for r in whole.select("id", "extra").collect()) == [(1, None), (2, "x")]
    assert infer.drop_null_columns(whole).columns == ["id", "extra"]
