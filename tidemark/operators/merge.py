"""Keyed merge of changes into a table, and the difference of two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

UPSERT = "upsert"
DELETE = "delete"


def apply_changes(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], op: str = "op"
) -> DataFrame:
    """The target after upserts and deletes, at most one change per key.

    Columns the changes lack keep their value, or are null on insert; an explicit
    null overwrites; columns the target lacks are ignored. A change of key columns
    only inserts the key if it is absent. Both sides are unique on the key, so the
    join is free of skew.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    supplied = [c for c in target.columns if c in changes.columns and c not in keys]
    change = changes.select(
        *[F.col(k).cast(types[k]).alias(k) for k in keys],
        F.col(op).alias("_op"),
        *[F.col(c).cast(types[c]).alias(f"_new_{c}") for c in supplied],
    )
    upserted = F.col("_op") == UPSERT
    columns = [
        F.when(upserted, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c)
        for c in target.columns
    ]
    joined = target.join(change, list(keys), "full_outer")
    return joined.filter(F.col("_op").isNull() | upserted).select(*columns)


def observed(changes: DataFrame, op: str = "op") -> tuple[DataFrame, Observation]:
    """The changes, and their upserts and deletes as counted by the pass that writes them.

    The counts are there once an action over the changes has ended; no pass is added.
    """
    seen = Observation()
    counts = [F.count_if(F.col(op) == kind).alias(f"{kind}s") for kind in (UPSERT, DELETE)]
    return changes.observe(seen, *counts), seen


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str], version: int
) -> DataFrame:
    """The change rows that lead from one snapshot of a table to the next.

    Values are compared null-safely. An update gives its row before and after.
    """
    rest = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*rest).alias("_old"))
    right = new.select(*keys, F.struct(*rest).alias("_new"))
    both = left.join(right, list(keys), "full_outer")

    def change(kind: str, row: str) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("_row"))

    rows = (
        F.when(F.col("_old").isNull(), F.array(change("insert", "_new")))
        .when(F.col("_new").isNull(), F.array(change("delete", "_old")))
        .when(
            ~F.col("_old").eqNullSafe(F.col("_new")),
            F.array(change("update_preimage", "_old"), change("update_postimage", "_new")),
        )
    )
    changed = both.select(*keys, F.explode(rows).alias("_change"))
    return changed.select(
        *keys,
        *[F.col(f"_change._row.{c}").alias(c) for c in rest],
        F.col("_change._change_type").alias("_change_type"),
        F.lit(version).cast("bigint").alias("_commit_version"),
    )
