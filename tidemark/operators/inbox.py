"""Lake-side changes: reading them, writing them and their net effect per key.

Change rows carry the data columns and ``_change_type`` (insert, delete,
update_preimage, update_postimage) and ``_commit_version``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.collapse import latest_per_key
from tidemark.operators.merge import DELETE, UPSERT

CHANGE_META = ("_change_type", "_commit_version", "_commit_timestamp")
PREIMAGE = "update_preimage"
# What stored tables call the column that says upsert or delete: data has no underscore names.
MARK = "_change"


def changes_since(changes: DataFrame, last_version: int = -1) -> DataFrame:
    """Changes of the versions after the last one processed, -1 being none."""
    return changes.filter(F.col("_commit_version") > last_version)


def missing_keys(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that cannot be applied because a key column is null."""
    return changes.filter(_any_null(keys))


def with_keys(rows: DataFrame, keys: Sequence[str], on_missing_key: str = "reject") -> DataFrame:
    """Rows that have a value in every key column; others are left out, or fail the job."""
    if on_missing_key not in ("reject", "fail"):
        raise ValueError(f"on_missing_key must be 'reject' or 'fail', not {on_missing_key!r}")
    if on_missing_key == "fail":
        failure = F.raise_error(F.lit(f"change without a value of its key {', '.join(keys)}"))
        return rows.filter(F.when(_any_null(keys), failure.cast("boolean")).otherwise(True))
    return rows.filter(~_any_null(keys))


def net_change(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    on_missing_key: str = "reject",
    preimage_deletes: bool = False,
    op: str = "op",
) -> DataFrame:
    """The last change of each key as one upsert or delete.

    Within a version deletes come first, then ``order``, then the data columns,
    so that the result never depends on arrival. Rows of null keys are left out
    (see ``missing_keys``) or fail the job. With ``preimage_deletes`` an update
    that moves a row to another key deletes the old key. ``op`` names the column
    that says upsert or delete; a data column of that name is refused, not overwritten.
    """
    if op in changes.columns:
        raise ValueError(f"the changes have a column {op!r}; give another name as op")
    valid = with_keys(changes, keys, on_missing_key)
    kind = F.col("_change_type")
    removes = kind.isin("delete", PREIMAGE) if preimage_deletes else kind == "delete"
    if not preimage_deletes:
        valid = valid.filter(kind != PREIMAGE)
    data = [c for c in valid.columns if c not in CHANGE_META and c not in keys]
    rows = valid.withColumns(
        {
            op: F.when(removes, DELETE).otherwise(UPSERT),
            "_rank": F.when(removes, 0).otherwise(1),
        }
    )
    rest = [c for c in data if c not in order]
    ranked = rows.select(*keys, *data, op, "_commit_version", "_rank")
    last = latest_per_key(ranked, keys, ["_commit_version", "_rank", *order, *rest])
    return last.select(*keys, op, *data)


def table_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of an inbox, from all its changes."""
    net = net_change(changes, keys, preimage_deletes=True, op=MARK)
    return net.filter(F.col(MARK) == UPSERT).drop(MARK)


def insert_rows(rows: DataFrame) -> DataFrame:
    """INSERT: the rows as change rows."""
    return rows.withColumn("_change_type", F.lit("insert"))


def update_rows(rows: DataFrame, where: Column, assign: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE: each matching row before and after."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    unknown = [c for c in assign if c not in types]
    if unknown:
        raise ValueError(f"no such column: {unknown}")
    before = F.struct(F.lit(PREIMAGE).alias("_change_type"), *rows.columns)
    after = F.struct(
        F.lit("update_postimage").alias("_change_type"),
        *[
            assign[c].cast(types[c]).alias(c) if c in assign else F.col(c)
            for c in rows.columns
        ],
    )
    both = rows.filter(where).select(F.explode(F.array(before, after)).alias("_row"))
    return both.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns], "_row._change_type")


def delete_rows(rows: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE: the matching rows."""
    return rows.filter(where).withColumn("_change_type", F.lit("delete"))


def _any_null(keys: Sequence[str]) -> Column:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return missing
