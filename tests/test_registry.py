"""Every registered query against its SQL, and the shape of its plan."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import rows_of
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
STORED = {
    "merge_store", "inbox_write", "feed_append", "feed_rejects", "feed_scan", "forward_stream",
    "incremental_state", "reverse_stream", "feed_bounded",
    "feed_limited", "streamed_state", "reverse_inboxes",
}
PYTHON = {"conflict_merge_arrow", "conflict_merge_python"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(names, cur.fetchall())
    assert got


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in STORED | PYTHON])
def test_plan_stays_inside_the_engine(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, f"{word} in the plan of {name}"


def test_scans_are_pruned(spark):
    plan = entry.queries()["high_water"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<topic:string,partition:int,offset:bigint>" in plan
    plan = entry.queries()["change_missing_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan


@pytest.mark.parametrize("name", ["current_state", "net_change", "latest_rank"])
def test_keys_collapse_before_the_shuffle(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    limit = plan.index("WindowGroupLimit")
    shuffle = plan.index("Exchange hashpartitioning", limit)
    assert "WindowGroupLimit" in plan[shuffle:]


def test_applied_changes_collapse_where_they_were_judged(spark):
    plan = entry.queries()["reverse_apply"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    judged = plan.index("Window [max(")
    limit = plan.rindex("WindowGroupLimit", 0, judged)
    assert "Exchange" not in plan[limit:judged]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
