"""Conflict policies for a row that changed on both sides."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

# Policy and side names, and the texts of the audit log.
LAST_WRITE_WINS = "last_write_wins"
SOURCE_OF_TRUTH = "source_of_truth"
MERGE = "merge"
ERROR = "error"
POLICIES = (LAST_WRITE_WINS, SOURCE_OF_TRUTH, MERGE, ERROR)
POSTGRES = "postgres"
LAKEHOUSE = "lakehouse"
SIDES = (POSTGRES, LAKEHOUSE)
NO_VERSION_TEXT = "last_write_wins requires a version on both rows; refusing to guess"
MERGE_TEXT = "column-level merge via merge_fn"

# A rule gives one column of the merged row from the two rows.
Rule = str | Callable[[Column, Column], Column]


def check_policy(policy: str, source_of_truth: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if source_of_truth not in SIDES:
        raise ValueError(f"invalid source_of_truth: {source_of_truth!r}")


def tie_text(version: Column, source_of_truth: str) -> Column:
    tail = F.lit(f"); broke tie via source_of_truth={source_of_truth}")
    return F.concat(F.lit("equal versions ("), version.cast("string"), tail)


def newer_text(side: str, newer: Column, older: Column) -> Column:
    head = F.lit(f"last_write_wins: {side} version ")
    return F.concat(head, newer.cast("string"), F.lit(" > "), older.cast("string"))


def always_text(source_of_truth: str) -> str:
    return f"source_of_truth={source_of_truth} wins unconditionally"


def conflict_text(rows: DataFrame, keys: Sequence[str]) -> Column:
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        quoted = isinstance(rows.schema[k].dataType, StringType)
        parts.append(F.concat(F.lit("'"), text, F.lit("'")) if quoted else text)
    key = parts[0] if len(parts) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))
    return F.concat(
        F.lit("conflict on key "), key, F.lit(" and policy=error; manual resolution required")
    )


def resolve(
    operational: DataFrame,
    lake: DataFrame,
    keys: Sequence[str],
    policy: str,
    source_of_truth: str = POSTGRES,
    version: str = "version",
    rules: Mapping[str, Rule] | None = None,
) -> DataFrame:
    """Settle the keys present on both sides; each side has one row per key.

    Gives ``winner`` (null where refused), ``error``, ``reason`` and both rows as
    the structs ``pg_row`` and ``lake_row``. Under the merge policy ``rules``
    says per column which side or which expression of both values to take, and
    ``merged`` has those columns.
    """
    check_policy(policy, source_of_truth)
    if policy == MERGE and not rules:
        raise ValueError("merge policy requires rules")
    pg = operational.select(*keys, F.struct(*operational.columns).alias("pg_row"))
    lk = lake.select(*keys, F.struct(*lake.columns).alias("lake_row"))
    both = pg.join(lk, list(keys), "inner")

    def version_of(side: str, columns: list[str]) -> Column:
        return F.col(f"{side}.{version}") if version in columns else F.lit(None).cast("bigint")

    p = version_of("pg_row", operational.columns)
    v = version_of("lake_row", lake.columns)
    sot = F.lit(source_of_truth)
    if policy == LAST_WRITE_WINS:
        refused = p.isNull() | v.isNull()
        winner = F.when(p == v, sot).when(p > v, POSTGRES).when(v > p, LAKEHOUSE)
        reason = (
            F.when(refused, NO_VERSION_TEXT)
            .when(p == v, tie_text(p, source_of_truth))
            .when(p > v, newer_text(POSTGRES, p, v))
            .otherwise(newer_text(LAKEHOUSE, v, p))
        )
    elif policy == SOURCE_OF_TRUTH:
        refused, winner, reason = F.lit(False), sot, F.lit(always_text(source_of_truth))
    elif policy == MERGE:
        refused, winner, reason = F.lit(False), sot, F.lit(MERGE_TEXT)
    else:
        refused = F.lit(True)
        winner, reason = F.lit(None).cast("string"), conflict_text(both, keys)
    settled = both.select(
        *keys, winner.alias("winner"), refused.alias("error"), reason.alias("reason"), "pg_row", "lake_row"
    )
    if policy == MERGE:
        merged = [_by_rule(rule, c).alias(c) for c, rule in rules.items()]
        settled = settled.withColumn("merged", F.struct(*merged))
    return settled


def _by_rule(rule: Rule, column: str) -> Column:
    pg, lake = F.col(f"pg_row.{column}"), F.col(f"lake_row.{column}")
    if callable(rule):
        return rule(pg, lake)
    if rule == POSTGRES:
        return pg
    if rule == LAKEHOUSE:
        return lake
    raise ValueError(f"unknown merge rule {rule!r} for column {column}")


def merge_with_python(
    operational: DataFrame,
    lake: DataFrame,
    keys: Sequence[str],
    merge_fn: Callable[[dict, dict], dict],
    schema: str,
) -> DataFrame:
    """Merge the pairs of rows with a Python function of two row dicts.

    ``schema`` is the DDL of the dict it returns. Pairs are independent, so they
    run in Arrow batches wherever the join put them. Prefer ``rules`` of
    ``resolve``, which stay inside the engine.
    """
    both = resolve(operational, lake, keys, SOURCE_OF_TRUTH).select("pg_row", "lake_row")

    def run(batches):
        for batch in batches:
            pairs = zip(batch["pg_row"], batch["lake_row"], strict=True)
            yield pd.DataFrame([merge_fn(dict(p), dict(k)) for p, k in pairs])

    return both.mapInPandas(run, schema)


def merge_with_arrow(
    operational: DataFrame,
    lake: DataFrame,
    keys: Sequence[str],
    merge_fn: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch | pa.Table],
    schema: str,
) -> DataFrame:
    """Merge the pairs of rows with a Python function of two Arrow batches.

    Row i of the first batch and row i of the second share a key; a batch holds some
    thousand pairs and is never empty. ``schema`` is the DDL of what the function
    returns, one row for each pair in order. Nothing is turned into Python objects, so
    it suits rules that Arrow's compute functions have and ``rules`` of ``resolve`` lacks.
    """
    both = resolve(operational, lake, keys, SOURCE_OF_TRUTH).select("pg_row", "lake_row")
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [pa.RecordBatch.from_struct_array(batch.column(n)) for n in ("pg_row", "lake_row")]
            merged = merge_fn(*sides)
            if merged.num_rows != batch.num_rows:
                raise ValueError(f"merge function gave {merged.num_rows} rows for {batch.num_rows} pairs")
            columns = [_cast(merged.column(f.name), f.type) for f in wanted]
            yield from pa.Table.from_arrays(columns, schema=wanted).to_batches()

    return both.mapInArrow(run, schema)


def _cast(column: pa.Array | pa.ChunkedArray, to: pa.DataType) -> pa.Array | pa.ChunkedArray:
    return column if column.type == to else column.cast(to)
