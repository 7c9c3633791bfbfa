"""Feeds, inboxes and keyed tables: redelivery, lost progress, crashes, streams."""

import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inbox, infer
from tidemark.operators import offsets as intervals
from tidemark.operators.merge import UPSERT
from tidemark.sources import adapters, cdc, feed, ledger, views
from tidemark.sources.inbox_store import Inbox
from tidemark.sources.keyed import KeyedTable, joined
from tidemark.streaming import current, forward, reverse

TOPIC = "cdc.p.proj_p.t"


def batch(spark, *offsets, topic=TOPIC, values=None):
    rows = []
    for o in offsets:
        value = {"id": o % 3, "val": f"v{o}", "__op": "u", "__ts_ms": 100 + o}
        text = json.dumps(value) if values is None else values.get(o, json.dumps(value))
        rows.append((topic, o % 2, o, text))
    return spark.createDataFrame(rows, cdc.MESSAGE_SCHEMA)


def offsets(spark, root):
    return sorted(r["offset"] for r in feed.read_feed(spark, root).collect())


def test_redelivery_appends_nothing_twice(spark, folder):
    assert feed.append(batch(spark, 0, 1, 2), folder) == 0
    assert feed.append(batch(spark, 0, 1, 2), folder) is None
    assert feed.append(batch(spark, 1, 2, 3, 4), folder) == 1
    assert offsets(spark, folder) == [0, 1, 2, 3, 4]
    history = {r["version"]: (r["operation"], r["rows"]) for r in feed.read_history(spark, folder).collect()}
    assert history == {0: ("append", 3), 1: ("append", 2)}


def test_offsets_may_come_late_and_twice(spark, folder):
    assert feed.append(batch(spark, 5, 9, 9, 7, 5), folder) == 0
    assert feed.append(batch(spark, 6, 5, 8, 0, 0), folder) == 1
    assert feed.append(batch(spark, 0, 5, 6), folder) is None
    assert offsets(spark, folder) == [0, 5, 6, 7, 8, 9]
    assert feed.append(batch(spark, 1, 10), folder, ordered=True) == 2  # the source vouches for its order
    assert offsets(spark, folder) == [0, 5, 6, 7, 8, 9, 10]


def test_files_of_interleaved_offsets_lose_nothing(spark, folder):
    rows = spark.range(400).selectExpr(
        f"'{TOPIC}' AS topic", "0 AS partition", "id AS offset", '''concat('{"id":', id, '}') AS value'''
    )
    rows.repartition(5).write.parquet(f"{folder}/log")
    stream = cdc.stream_files(spark, f"{folder}/log", max_files_per_trigger=1)
    forward.start(stream, f"{folder}/feed", f"{folder}/check", interval=None).awaitTermination()
    assert offsets(spark, f"{folder}/feed") == list(range(400))


def test_append_reads_no_stored_data(spark, folder):
    """What is new is told by the ledger alone, also for late, missing and repeated offsets."""
    feed.append(batch(spark, 0, 2, 4, 9, 13), folder)
    kept = {p: p.read_bytes() for p in Path(folder, "data").rglob("*.parquet")}
    for p in kept:
        p.write_bytes(b"not to be read")
    assert feed.append(batch(spark, 1, 2, 2, 4, 6, 7, 13, 14, 14), folder) == 1
    assert feed.append(batch(spark, 0, 1, 2, 4, 6, 7, 9, 13, 14), folder) is None
    for p, data in kept.items():
        p.write_bytes(data)
    assert offsets(spark, folder) == [0, 1, 2, 4, 6, 7, 9, 13, 14]
    done = sorted((r["partition"], r["min_offset"], r["max_offset"]) for r in feed.committed_offsets(spark, folder).collect())
    assert done == [(0, k, k) for k in (0, 2, 4, 6, 14)] + [(1, k, k) for k in (1, 7, 9, 13)]
    assert [r["rows"] for r in feed.read_history(spark, folder).orderBy("version").collect()] == [5, 4]


@pytest.mark.parametrize("seed", range(3))
def test_intervals_are_the_set_of_offsets(spark, seed, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 8)
    r = random.Random(seed)
    logs = [("t", 0), ("t", 1), ("u", 0)]
    pick = lambda n: [(*r.choice(logs), r.randrange(-20, 120), "x") for _ in range(n)]
    schema = "topic STRING, partition INT, offset BIGINT, value STRING"
    old, new = pick(150), pick(120) + [(None, 0, 5, "x"), ("v", 0, 5, "x")]
    done = intervals.merged(
        intervals.islands(spark.createDataFrame(old[:70], schema)).unionByName(
            intervals.islands(spark.createDataFrame(old[70:], schema))
        )
    ).collect()
    covered = {(i["topic"], i["partition"], o) for i in done for o in range(i["min_offset"], i["max_offset"] + 1)}
    assert covered == {x[:3] for x in old}
    for a in done:  # intervals neither overlap nor touch
        assert not any(a[:2] == b[:2] and a != b and b["min_offset"] <= a["max_offset"] + 1 and a["min_offset"] <= b["max_offset"] + 1 for b in done)
    left = intervals.fresh(spark.createDataFrame(new, schema), spark.createDataFrame(done))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted({str(x) for x in new if x[:3] not in covered})


def test_sets_of_offsets_with_bits(spark):
    r = random.Random(5)
    schema = "topic STRING, partition INT, offset BIGINT, value STRING"
    edges = [-(2**63), -257, -256, -1, 0, 255, 256, 2**60 + 255, 2**60 + 256]
    first = [*range(300, 1100), *edges[::2], *r.sample(range(5000, 9000), 900)]
    second = [*range(256, 300), *range(1100, 1280), *edges[1::2], *r.sample(range(5000, 9000), 900)]
    rows = lambda found: spark.createDataFrame([("t", 0, o, "x") for o in found], schema)
    done = spark.createDataFrame([], intervals.DONE)
    for part in (first, second):
        done = spark.createDataFrame(intervals.added(done, rows(part)).collect(), intervals.DONE)
    assert done.count() < 30 and done.filter("bits IS NULL").count() == 1  # 256 to 1279, whole
    want = sorted({*first, *second})
    ends = sorted((i["min_offset"], i["max_offset"]) for i in intervals.intervals(done).collect())
    assert [o for a, b in ends for o in range(a, b + 1)] == want
    assert all(b + 1 < c for (_, b), (c, _) in zip(ends, ends[1:]))
    new = [*r.sample(want, 50), *range(-300, -250), *range(1270, 1290), *r.sample(range(5000, 9000), 500), -(2**63)]
    got = sorted(x["offset"] for x in intervals.fresh(rows(new + new[:100]), done).collect())
    assert got == sorted(set(new) - set(want))


def test_gaps_everywhere_leave_a_ledger_entry_small(spark, folder):
    """Every offset is an interval of its own, and no task writes them all."""
    assert feed.append(batch(spark, *range(2000)), folder) == 0
    assert ledger.entries(spark, folder, feed.ENTRY).count() == 2
    assert feed.committed_offsets(spark, folder).count() == 2000
    assert feed.append(batch(spark, *range(1990, 2010)), folder) == 1
    rows = sorted((r["partition"], r["min_offset"], r["max_offset"], r["rows"]) for r in
                  ledger.entries(spark, folder, feed.ENTRY).filter("version = 1").collect())
    assert rows == [(0, 0, 2008, 5), (1, 1, 2009, 5)]


def test_rejects_and_tombstones_count_as_seen(spark, folder):
    values = {1: None, 3: '{"__op":"c"}', 4: "{bad"}
    feed.append(batch(spark, 0, 1, 2, 3, 4, values=values), folder)
    assert offsets(spark, folder) == [0, 2]
    assert sorted(r["reason"] for r in feed.read_rejects(spark, folder).collect()) == ["invalid_json", "no_data_columns"]
    marks = {r["partition"]: r["max_offset"] for r in feed.offset_marks(spark, folder).collect()}
    assert marks == {0: 4, 1: 3}
    assert feed.append(batch(spark, 0, 1, 2, 3, 4), folder) is None


def test_marks_are_carried_over(spark, folder):
    feed.append(batch(spark, 0, 1), folder)
    feed.append(batch(spark, 5, topic="cdc.q.proj_q.u"), folder)
    assert feed.append(batch(spark, 0, 1), folder) is None
    tables = {(r["project"], r["table"]) for r in feed.read_feed(spark, folder).collect()}
    assert tables == {("p", "t"), ("q", "u")}


def test_crash_between_data_and_ledger(spark, folder, monkeypatch):
    feed.append(batch(spark, 0, 1), folder)

    def crash(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commit", crash)
        with pytest.raises(RuntimeError):
            feed.append(batch(spark, 2, 3, 4), folder)
    assert offsets(spark, folder) == [0, 1]
    assert feed.append(batch(spark, 2, 3), folder) == 1
    assert offsets(spark, folder) == [0, 1, 2, 3]


def test_scan_by_name_evolves_its_columns(spark, folder):
    feed.append(batch(spark, 0, 1), folder)
    late = {2: json.dumps({"id": 2, "val": "v2", "extra": 7, "__op": "c", "__ts_ms": 1})}
    feed.append(batch(spark, 2, values=late), folder)
    name = feed.register_view(spark, folder, "p", "t", "id BIGINT, val STRING, extra INT")
    assert name == "proj_p_t"
    got = spark.sql(f"SELECT val, extra FROM {name} ORDER BY val").collect()
    assert [tuple(r) for r in got] == [("v0", None), ("v1", None), ("v2", 7)]
    plan = spark.table(name)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "project" in plan.split("PartitionFilters")[1]


def test_views_of_all_tables_without_columns(spark, folder):
    """Types widen over commits; odd names, clashes with marks and with each other; columns without values are left out."""
    def send(*docs, topic=TOPIC):
        first = send.next
        send.next += len(docs)
        rows = [(topic, 0, first + i, json.dumps(d)) for i, d in enumerate(docs)]
        return feed.append(spark.createDataFrame(rows, cdc.MESSAGE_SCHEMA), folder)

    send.next = 0
    assert views.register_views(spark, folder) == []
    send({"id": 1, "n": 1, "x": None, "op": "a", "_op": 5, "Id": "big"}, {"id": 2, "n": 2, "m": 1})
    assert views.register_views(spark, folder) == ["proj_p_t"]
    first = spark.table("proj_p_t")
    assert [c for c in first.columns if c not in views.MARKS] == ["Id", "_op_", "id_", "m", "n", "op"]
    assert dict(first.dtypes)["n"] == "bigint"
    state = Path(folder, "columns", "ledger")
    assert len(list(state.glob("version=*"))) == 1
    send({"id": 3, "n": 2.5, "m": "one", "x": True, "it's \"odd\"": [1], "a.b['c']\\": 8}, {"id": 4, "o": {"b": 1, "a": None}})
    send({"a": 10.25}, {"a": 1e300}, {"a": 7}, topic="cdc.p.proj_p.u")
    assert views.register_views(spark, folder, "p") == ["proj_p_t", "proj_p_u"]
    got = spark.table("proj_p_t").orderBy("_offset")
    types = dict(got.dtypes)
    assert types["n"].startswith("decimal") and types["m"] == types["o"] == "string" and types["x"] == "boolean"
    assert [(r["id_"], r["n"] and float(r["n"]), r["m"], r["x"], r["_op_"], r["op"]) for r in got.collect()] == [
        (1, 1.0, None, None, 5, "a"), (2, 2.0, "1", None, None, None), (3, 2.5, "one", True, None, None), (4, None, None, None, None, None)
    ]
    assert [r["it's \"odd\""] for r in got.collect()] == [None, None, "[1]", None]
    assert [r["a.b['c']\\"] for r in got.collect()] == [None, None, 8, None]
    assert [r["o"] for r in got.collect()][-1] == '{"a":null,"b":1}'
    assert [r["a"] for r in spark.sql("SELECT a FROM proj_p_u ORDER BY _offset").collect()] == [10.25, 1e300, 7.0]
    # states of single commits merge to the state of all rows
    rows = feed.read_feed(spark, folder)
    whole = infer.column_types(infer.merge_states(infer.column_state(rows)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, views.columns(spark, folder).collect()))


def test_stream_survives_a_lost_checkpoint(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "feed")
    for i, part in enumerate([(0, 1, 2), (3, 4, 5), (2, 6)]):
        batch(spark, *part).coalesce(1).write.mode("append").parquet(source)
        stream = cdc.stream_files(spark, source, max_files_per_trigger=10)
        checkpoint = str(tmp_path / ("a" if i < 2 else "b"))
        forward.start(stream, root, checkpoint, interval=None).awaitTermination()
    assert offsets(spark, root) == [0, 1, 2, 3, 4, 5, 6]


def table(folder, buckets=4):
    return KeyedTable(folder, "id BIGINT, label STRING, score DECIMAL(6,2)", ("id",), buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(str(tmp_path / "t"), buckets=16)
    many = spark.range(100).select("id", F.lit("x").alias("label"), F.lit(1).alias("score"), F.lit(UPSERT).alias("op"))
    t.merge(many)
    one = spark.createDataFrame([(5, "y", "upsert"), (6, None, "delete")], "id INT, label STRING, op STRING")
    t.merge(one)
    got = {r["id"]: r["label"] for r in t.read(spark).collect()}
    assert len(got) == 99 and got[5] == "y" and 6 not in got and got[7] == "x"
    _, places, _ = t._newest(spark)
    assert 0 < sum(v == 1 for v in places.values()) <= 2


def test_emptied_table(spark, tmp_path):
    t = table(str(tmp_path / "t"))
    t.merge(spark.createDataFrame([(1, "a", "upsert")], "id BIGINT, label STRING, op STRING"), "src", 3)
    t.merge(spark.createDataFrame([(1, "a", "delete")], "id BIGINT, label STRING, op STRING"), "src", 4)
    assert rows(t.read(spark)) == [] and t.progress(spark, "src") == 4


def test_progress_of_several_sources(spark, tmp_path):
    t = table(str(tmp_path / "t"))
    rows_of = lambda i: spark.createDataFrame([(i, "a", "upsert")], "id BIGINT, label STRING, op STRING")
    t.merge(rows_of(1), "s1", 5)
    t.merge(rows_of(2), "s2", 9)
    t.merge(rows_of(3))
    assert (t.progress(spark, "s1"), t.progress(spark, "s2"), t.progress(spark, "s3")) == (5, 9, -1)
    t.merge(rows_of(4), "s1", 3)
    assert t.marks(spark) == {"s1": 5, "s2": 9} and t.read(spark).count() == 4


def test_marks_join_in_any_order():
    parts = [{"a": 3}, {"b": 1, "a": 1}, {"b": 7}, {}]
    for order in itertools.permutations(parts):
        whole = {}
        for part in order:
            whole = joined(whole, part)
        assert whole == {"a": 3, "b": 7}


def test_one_failing_inbox_leaves_the_others_alone(spark, tmp_path):
    good, bad = make_inbox(spark, str(tmp_path / "good")), make_inbox(spark, str(tmp_path / "bad"))
    shared = table(str(tmp_path / "t"))
    other = KeyedTable(str(tmp_path / "other"), "nothing BIGINT", ("nothing",), 2)
    for box, i in ((good, 1), (bad, 2)):
        box.insert(spark.createDataFrame([(i, "x")], "id BIGINT, label STRING"))
    done = reverse.process_all(spark, {"bad": (bad, other), "good": (good, shared)})
    assert done["good"] == 1 and isinstance(done["bad"], Exception)
    # The second round takes up where each stopped.
    assert reverse.process_all(spark, {"good": (good, shared), "mended": (bad, shared)}) == {"good": None, "mended": 1}
    assert [r[0] for r in rows(shared.read(spark))] == [1, 2]


def make_inbox(spark, root):
    box = Inbox(root, ("id",))
    box.create(spark, "id BIGINT, label STRING")
    return box


def test_inbox_to_target(spark, tmp_path):
    box, t = make_inbox(spark, str(tmp_path / "box")), table(str(tmp_path / "t"))
    assert reverse.process(spark, box, t) == 0
    assert reverse.process(spark, box, t) is None
    box.insert(spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, label STRING"))
    reverse.process(spark, box, t)
    box.update(spark, F.col("id") == 1, {"label": F.lit("z")})
    box.delete(spark, F.col("id") == 2)
    assert reverse.process(spark, box, t) == 3
    assert [r[:2] for r in rows(t.read(spark))] == [(1, "z")]
    assert rows(box.rows(spark)) == [(1, "z")]
    # A re-created inbox starts at version 0 again and is not taken for processed.
    again = make_inbox(spark, str(tmp_path / "box2"))
    again.insert(spark.createDataFrame([(7, "n")], "id BIGINT, label STRING"))
    assert reverse.process(spark, again, t) == 1
    assert [r[:2] for r in rows(t.read(spark))] == [(1, "z"), (7, "n")]
    with pytest.raises(ValueError):
        Inbox(str(tmp_path / "x"), ("id",)).create(spark, "label STRING")


def test_failed_apply_leaves_progress(spark, tmp_path, monkeypatch):
    box, t = make_inbox(spark, str(tmp_path / "box")), table(str(tmp_path / "t"))
    box.insert(spark.createDataFrame([(1, "a")], "id BIGINT, label STRING"))
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            reverse.process(spark, box, t)
    assert t.progress(spark, box.dataset(spark)) == -1 and rows(t.read(spark)) == []
    assert reverse.process(spark, box, t) == 1 and t.read(spark).count() == 1


def test_reverse_stream(spark, tmp_path):
    box, t = make_inbox(spark, str(tmp_path / "box")), table(str(tmp_path / "t"))
    for label in ("a", "b"):
        box.insert(spark.createDataFrame([(1, label)], "id BIGINT, label STRING"))
        reverse.start(spark, box, t, str(tmp_path / "cp"), interval=None).awaitTermination()
        assert t.read(spark).first()["label"] == label


def test_incremental_state_ignores_late_and_repeated(spark, tmp_path):
    state = current.state_table(str(tmp_path / "s"), "id BIGINT, val STRING", ("id",), buckets=2)
    gone = {9: json.dumps({"id": 0, "val": "d", "__op": "d", "__ts_ms": 999, "__deleted": "true"})}
    current.fold(batch(spark, 3, 4, 5), "id BIGINT, val STRING", state)
    current.fold(batch(spark, 0, 1, 2), "id BIGINT, val STRING", state)
    current.fold(batch(spark, 9, values=gone), "id BIGINT, val STRING", state)
    current.fold(batch(spark, 3, 6), "id BIGINT, val STRING", state)
    live = {r["id"]: r["val"] for r in current.live_rows(spark, state).collect()}
    assert live == {1: "v4", 2: "v5"}


def test_streamed_state_hands_on_touched_keys_only(spark, tmp_path):
    columns, root = "id BIGINT, val STRING", str(tmp_path / "log")
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    gone = {9: json.dumps({"id": 0, "val": "d", "__op": "d", "__ts_ms": 999, "__deleted": "true"})}
    keyless = {10: json.dumps({"id": None, "val": "n", "__op": "c", "__ts_ms": 1000})}

    def step(rows):
        rows.write.mode("append").parquet(source)
        stream = cdc.stream_files(spark, source)
        current.start_changes(stream, columns, ("id",), root, checkpoint, interval=None).awaitTermination()
        newest = max(ledger.partition_values(ledger.entries(spark, root, current.ENTRY), "version"))
        touched = spark.read.parquet(f"{root}/data/version={newest}")
        return sorted((r["id"], r["val"]) for r in touched.collect())

    assert step(batch(spark, 3, 4, 5)) == [(0, "v3"), (1, "v4"), (2, "v5")]
    # Each step is a restart: an older change and a repeated one touch their keys and change nothing.
    assert step(batch(spark, 0, 4)) == [(0, "v3"), (1, "v4")]
    assert step(batch(spark, 9, 10, values=gone | keyless)) == [(0, "d")]
    live = lambda: {r["id"]: r["val"] for r in current.live_changes(spark, columns, ("id",), root).collect()}
    assert live() == {1: "v4", 2: "v5"}
    current.compact(spark, columns, ("id",), root)
    assert live() == {1: "v4", 2: "v5"}
    # A lost checkpoint reads all messages again; a change older than the delete cannot undo it.
    checkpoint = str(tmp_path / "cp2")
    step(batch(spark, 6, 7))
    assert live() == {1: "v7", 2: "v5"}


def test_null_keys_of_the_state(spark, tmp_path):
    keyless = {10: json.dumps({"id": None, "val": "n", "__op": "c", "__ts_ms": 1000})}
    state = current.state_table(str(tmp_path / "s"), "id BIGINT, val STRING", ("id",), buckets=2)
    current.fold(batch(spark, 1, 10, values=keyless), "id BIGINT, val STRING", state)
    assert [r["id"] for r in state.read(spark).collect()] == [1]
    with pytest.raises(Exception, match="without a value of its key"):
        current.fold(batch(spark, 10, values=keyless), "id BIGINT, val STRING", state, on_missing_key="fail")


def test_versions_of_bounded_size(spark, tmp_path):
    root = str(tmp_path / "feed")
    many = batch(spark, *range(40), 7, 7, 39)
    feed.append(batch(spark, 5, 6), root)
    assert feed.append_limited(many, root, 9) == [1, 2, 3, 4, 5]
    assert offsets(spark, root) == list(range(40))
    sizes = {r["version"]: r["count"] for r in feed.read_feed(spark, root).groupBy("version").count().collect()}
    assert max(sizes.values()) <= 9 and len(sizes) == 6
    assert feed.append_limited(many, root, 9) == []
    with pytest.raises(ValueError):
        feed.append_limited(many, root, 0)
    assert feed.append_limited(many.limit(0), root, 9) == []


def test_crash_between_two_cuts(spark, tmp_path, monkeypatch):
    root, taken = str(tmp_path / "feed"), []
    whole, commit = batch(spark, *range(20)), ledger.commit

    def failing(entry, at, version):
        if version == 2 and not taken:
            taken.append(version)
            raise RuntimeError("lost")
        commit(entry, at, version)

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commit", failing)
        with pytest.raises(RuntimeError):
            feed.append_limited(whole, root, 6)
    assert len(offsets(spark, root)) == 12
    feed.append_limited(whole, root, 6)
    assert offsets(spark, root) == list(range(20))


def test_inbox_with_a_column_op(spark, tmp_path):
    box = Inbox(str(tmp_path / "box"), ("id",))
    box.create(spark, "id BIGINT, op STRING")
    t = KeyedTable(str(tmp_path / "t"), "id BIGINT, op STRING", ("id",), 2)
    box.insert(spark.createDataFrame([(1, "hello"), (2, "bye")], "id BIGINT, op STRING"))
    box.delete(spark, F.col("op") == "bye")
    reverse.process(spark, box, t)
    assert rows(t.read(spark)) == [(1, "hello")]
    with pytest.raises(ValueError, match="op"):
        inbox.net_change(box.changes(spark), ("id",))


def test_adapter_options():
    kafka = adapters.kafka_options("h:9092", max_offsets_per_trigger=500)
    assert kafka["startingOffsets"] == "earliest" and kafka["maxOffsetsPerTrigger"] == "500"
    jdbc = adapters.jdbc_options("jdbc:x", "t", "id", (0, 100), 4)
    assert (jdbc["partitionColumn"], jdbc["numPartitions"]) == ("id", "4")
    assert "partitionColumn" not in adapters.jdbc_options("jdbc:x", "t")
    assert adapters.upsert_statement("t", ["id"], ["id", "a"]).endswith('DO UPDATE SET "a" = EXCLUDED."a"')
    assert adapters.upsert_statement("t", ["id"], ["id"]).endswith("DO NOTHING")
    assert adapters.delete_statement("t", ["a", "b"]).endswith('WHERE "a" = ? AND "b" = ?')
    assert adapters.delta_append_options("t::0", 7)["txnVersion"] == "7"
    assert adapters.delta_change_options(-1)["startingVersion"] == "0"
    sql = adapters.delta_merge_sql("t", "s", ["id"], ["id", "a"])
    assert "WHEN MATCHED THEN UPDATE SET t.`a` = s.`a`" in sql and "THEN DELETE" in sql


def test_partition_writer(spark, tmp_path):
    path = str(tmp_path / "calls")

    class Recorder:
        """A connection that writes down what it is asked to do once committed."""

        def __init__(self):
            self.calls = []

        def cursor(self):
            return self

        def executemany(self, statement, rows):
            self.calls.append([statement.split()[0], [list(r) for r in rows]])

        def commit(self):
            with open(path, "a") as out:
                out.write(json.dumps(self.calls) + "\n")

        def close(self):
            pass

    changes = spark.createDataFrame(
        [(1, "new", "upsert"), (2, None, "delete"), (3, "new", "upsert")], "id INT, a STRING, op STRING"
    )
    adapters.write_partitions(changes.coalesce(1), Recorder, "t", ["id"])
    with open(path) as calls:
        assert json.loads(calls.read()) == [["DELETE", [[2]]], ["INSERT", [[1, "new"], [3, "new"]]]]
