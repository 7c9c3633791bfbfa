"""The running-value form of reverse sync against stepping through the changes."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conflict as cf
from tidemark.operators import reverse as rv
from tidemark.operators import running

CHANGES = "k STRING, seq BIGINT, val BIGINT, version BIGINT"
TARGET = "k STRING, val BIGINT, keep STRING, version BIGINT"
LEDGER = "k STRING, lake_version BIGINT"
ROUNDS = [
    ("last_write_wins", "postgres"), ("last_write_wins", "lakehouse"), ("source_of_truth", "postgres"),
    ("source_of_truth", "lakehouse"), ("merge", "postgres"), ("error", "postgres"),
]


def step(v, exists, p, l, policy, sot):
    """One change after the other, as the service does it."""
    if l is not None and v is not None and v <= l:
        return "skip_duplicate"
    if not exists:
        return "apply"
    if policy == "last_write_wins":
        if p is None or v is None:
            return "error"
        if v == p:
            return "apply" if sot == "lakehouse" else "skip_pg_wins"
        return "apply" if v > p else "skip_pg_wins"
    if policy == "source_of_truth":
        return "apply" if sot == "lakehouse" else "skip_pg_wins"
    return "apply_merge" if policy == "merge" else "error"


def fold(changes, target, ledger, policy, sot):
    rows = {k: (True, version) for k, _, _, version in target}
    applied = dict(ledger)
    actions = {}
    for k, seq, _, v in sorted(changes, key=lambda c: (c[0], c[1])):
        exists, p = rows.get(k, (False, None))
        action = step(v, exists, p, applied.get(k), policy, sot)
        actions[k, seq] = action
        if action.startswith("apply"):
            rows[k], applied[k] = (True, v), v
    return actions, applied


def data(seed, n=1500, keys=60, nulls=0.1, hot=0.4):
    rng = random.Random(seed)
    pick = lambda: "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
    version = lambda: None if rng.random() < nulls else rng.randrange(40)
    changes = [(pick(), i, rng.randrange(1000), version()) for i in range(n)]
    target = [(f"k{i}", i, "x", version()) for i in range(0, keys, 2)]
    ledger = [(f"k{i}", version()) for i in range(0, keys, 3)]
    if seed % 2:
        target.append(("hot", 0, "x", 3))
    return changes, target, ledger


@pytest.mark.parametrize("policy, sot", ROUNDS)
@pytest.mark.parametrize("cuts", [1, 20])
def test_fold(spark, policy, sot, cuts):
    for seed, nulls in ((1, 0.0), (2, 0.1)) if cuts == 1 else ((3, 0.02), (4, 0.1)):
        changes, target, ledger = data(seed, nulls=nulls)
        c, t, l = (
            spark.createDataFrame(rows, schema)
            for rows, schema in ((changes, CHANGES), (target, TARGET), (ledger, LEDGER))
        )
        decided = rv.decide(c, t, l, ["k"], ["seq"], "version", policy, sot, cuts=cuts)
        want, advanced = fold(changes, target, ledger, policy, sot)
        got = {(r["k"], r["seq"]): r["action"] for r in decided.collect()}
        assert got == want
        new = rv.advance_ledger(l, decided, ["k"], ["seq"], "version")
        assert {r["k"]: r["lake_version"] for r in new.collect()} == advanced


def test_hot_keys_are_cut(spark):
    changes, _, _ = data(5)
    c = spark.createDataFrame(changes, CHANGES)
    cuts = running.find_cuts(c, ["k"], ["seq"], 20)
    parts = cuts.assign(c).filter("k = 'hot'").groupBy("_part").count().collect()
    total = sum(r["count"] for r in parts)
    assert len(parts) > 6 and max(r["count"] for r in parts) < total / 4
    assert sum(len(r["_cuts"]) for r in cuts.at.collect()) <= 20


ORDERS = {
    "distinct": lambda r, i: (float(i), r.randrange(9)),
    "ties": lambda r, i: (1.0, 1),
    "odd": lambda r, i: (r.choice([None, float("nan"), float("-inf"), -0.5, 2.0, float(i % 7)]), r.choice([None, 1, 2])),
}


@pytest.mark.parametrize("kind", ORDERS)
@pytest.mark.parametrize("policy, sot", ROUNDS)
def test_scan_of_one_key_with_most_rows(spark, kind, policy, sot):
    """Ties, nulls and NaN in the order, null keys, one key with most rows: as stepping through them in order."""
    rng = random.Random(len(kind))
    rows = []
    for i in range(1200):
        key = rng.choice(["hot"] * 8 + ["a", "b", None])
        rows.append((key, *ORDERS[kind](rng, i), i, rng.choice([None, *range(30)]) if i % 5 else 3))
    c = spark.createDataFrame(rows, "k STRING, at DOUBLE, then INT, val BIGINT, version BIGINT").repartition(3)
    target = [("hot", 0, "x", 4), ("b", 0, "x", None)]
    t = spark.createDataFrame(target, TARGET)
    l = spark.createDataFrame([("hot", 2), ("a", 5)], LEDGER)
    ordered = c.withColumn("tie", running.tie(c.columns)).orderBy("k", "at", "then", "tie").collect()
    steps = [(r["k"] or "", n, r["val"], r["version"]) for n, r in enumerate(ordered)]
    want, _ = fold(steps, target, [("hot", 2), ("a", 5)], policy, sot)
    by_value = {val: want[k, n] for k, n, val, _ in steps}
    for cuts in (1, 15):
        got = rv.decide(c, t, l, ["k"], ["at", "then"], "version", policy, sot, cuts=cuts).collect()
        assert len(got) == len(rows) and {r["val"]: r["action"] for r in got} == by_value


def test_scan_is_one_plan_and_moves_rows_once(spark):
    """Finding cuts runs no job, and the scan adds no shuffle of the rows to that of the join before it."""
    changes, target, ledger = data(6)
    c, t, l = (spark.createDataFrame(rows, schema) for rows, schema in ((changes, CHANGES), (target, TARGET), (ledger, LEDGER)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cuts", "cuts")
    decided = rv.decide(c, t, l, ["k"], ["seq"], "version")
    assert not tracker.getJobIdsForGroup("cuts")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert decided.count() == len(changes)


def decide_one(spark, version, row=None, last=None, policy="last_write_wins", sot="postgres"):
    c = spark.createDataFrame([("k", 1, 99, version)], CHANGES)
    t = spark.createDataFrame([("k", 0, "x", row)] if row else [], TARGET)
    l = spark.createDataFrame([("k", last)] if last else [], LEDGER)
    got = rv.decide(c, t, l, ["k"], ["seq"], "version", policy, sot).first()
    return got["action"], got["reason"]


def test_decision_cases(spark):
    assert decide_one(spark, 10) == ("apply", "no existing Postgres row; inserting")
    assert decide_one(spark, 5, 3, last=5) == ("skip_duplicate", "lake version 5 <= last applied 5")
    assert decide_one(spark, 4, 10, last=7)[0] == "skip_duplicate"
    assert decide_one(spark, 20, 10) == ("apply", "last_write_wins: lakehouse version 20 > 10")
    assert decide_one(spark, 5, 50) == ("skip_pg_wins", "last_write_wins: postgres version 50 > 5")
    assert decide_one(spark, 999, 1, policy="source_of_truth")[0] == "skip_pg_wins"
    assert decide_one(spark, 2, 1, policy="merge")[0] == "apply_merge"
    assert decide_one(spark, 2, 1, policy="error") == (
        "error", "conflict on key 'k' and policy=error; manual resolution required"
    )
    assert decide_one(spark, 7, 7, sot="lakehouse") == (
        "apply", "equal versions (7); broke tie via source_of_truth=lakehouse"
    )


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        decide_one(spark, 1, policy="coin_flip")
    with pytest.raises(ValueError):
        decide_one(spark, 1, policy="source_of_truth", sot="mars")


def pair(spark, pg, lake):
    a = spark.createDataFrame([pg], "k STRING, a BIGINT, b BIGINT, version BIGINT")
    b = spark.createDataFrame([lake], "k STRING, a BIGINT, b BIGINT, version BIGINT")
    return a, b


def test_conflict_pairs(spark):
    def winner(pg, lake, policy="last_write_wins", **kw):
        rows = cf.resolve(*pair(spark, ("k", 2, 0, pg), ("k", 9, 5, lake)), ["k"], policy, **kw)
        row = rows.first()
        return row["winner"], row["error"]

    assert winner(200, 100) == ("postgres", False)
    assert winner(100, 300) == ("lakehouse", False)
    assert winner(100, 100, source_of_truth="lakehouse") == ("lakehouse", False)
    assert winner(None, 100) == (None, True)
    assert winner(1, 999, "source_of_truth") == ("postgres", False)
    assert winner(1, 2, "error") == (None, True)
    other = cf.resolve(*pair(spark, ("k1", 1, 1, 1), ("k2", 1, 1, 1)), ["k"], "last_write_wins")
    assert other.count() == 0
    with pytest.raises(ValueError):
        winner(1, 2, "merge")


def test_merge_by_rules_and_by_function(spark):
    pg, lake = pair(spark, ("k", 1, 0, 1), ("k", 0, 5, 2))
    rules = {"a": "postgres", "b": lambda p, l: F.greatest(p, l)}
    assert tuple(cf.resolve(pg, lake, ["k"], "merge", rules=rules).first()["merged"]) == (1, 5)
    merged = cf.merge_with_python(pg, lake, ["k"], lambda p, l: {"a": p["a"], "b": l["b"]}, "a BIGINT, b BIGINT")
    assert tuple(merged.first()) == (1, 5)


def test_merge_by_arrow_batches(spark):
    pg, lake = pair(spark, ("k", 1, 0, 1), ("k", 0, 5, 2))

    def pick(p, l):
        return pa.table({"b": l["b"], "a": pc.cast(p["a"], pa.int32())})

    # Columns go by name and are cast to the declared types.
    merged = cf.merge_with_arrow(pg, lake, ["k"], pick, "a BIGINT, b BIGINT")
    assert tuple(merged.first()) == (1, 5) and merged.columns == ["a", "b"]
    assert cf.merge_with_arrow(pg.limit(0), lake, ["k"], pick, "a BIGINT, b BIGINT").count() == 0
    with pytest.raises(Exception, match="0 rows for 1 pairs"):
        cf.merge_with_arrow(pg, lake, ["k"], lambda p, l: pick(p, l).slice(1), "a BIGINT, b BIGINT").collect()


def test_merge_rules_fold(spark):
    changes = [("old", 1, 5, 1), ("old", 2, 9, 2), ("old", 3, 7, 3), ("new", 1, 4, 1), ("new", 2, 3, 2)]
    target = [("old", 6, "x", 0)]
    c, t = spark.createDataFrame(changes, CHANGES), spark.createDataFrame(target, TARGET)
    l = spark.createDataFrame([], LEDGER)
    decided = rv.decide(c, t, l, ["k"], ["seq"], "version", "merge")

    def merged(rule):
        rows = rv.apply_decided(t, decided, ["k"], ["seq"], {"val": rule, "version": "lakehouse"})
        return {r["k"]: (r["val"], r["keep"], r["version"]) for r in rows.collect()}

    assert merged("greatest") == {"old": (9, "x", 3), "new": (4, None, 2)}
    assert merged("least") == {"old": (5, "x", 3), "new": (3, None, 2)}
    assert merged("lakehouse") == {"old": (7, "x", 3), "new": (3, None, 2)}
    assert merged("postgres") == {"old": (6, "x", 3), "new": (4, None, 2)}
    assert merged("coalesce") == {"old": (6, "x", 3), "new": (4, None, 2)}
    with pytest.raises(ValueError):
        merged("average")


def test_composite_keys_and_extra_columns(spark):
    c = spark.createDataFrame([(1, "a", 1, 5, "ignored")], "x INT, y STRING, seq BIGINT, version BIGINT, extra STRING")
    t = spark.createDataFrame([(1, "a", 3), (1, "b", 3)], "x BIGINT, y STRING, version BIGINT")
    l = spark.createDataFrame([], "x BIGINT, y STRING, lake_version BIGINT")
    decided = rv.decide(c, t, l, ["x", "y"], ["seq"], "version")
    assert decided.first()["action"] == "apply"
    rows = rv.apply_decided(t, decided, ["x", "y"], ["seq"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", 5), (1, "b", 3)]
    report = rv.report(decided).first()
    assert tuple(report) == ("apply", 1, 1)
