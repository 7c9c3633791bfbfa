"""Every table of a feed by name, with the columns its messages have shown so far.

What is known of the columns is kept as mergeable state, one small version each time
the views are made: only the commits since the last one are read for it, and the state
of the commits before is merged in.

Marks of a row have underscores (``MARKS``), so that data columns keep their names,
``op``, ``version`` and ``offset`` among them. A data column called like a mark, or like
another one but for case, gets further underscores at its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import infer
from tidemark.sources import feed, ledger

MARKS = {
    "_op": "_op", "_ts_ms": "_ts_ms", "_deleted": "_deleted", "_version": "version", "_topic": "topic",
    "_partition": "partition", "_offset": "offset",
}


def columns(spark: SparkSession, root: str) -> DataFrame:
    """The columns of all tables: project, table, name, since (first version), type."""
    return infer.column_types(_state(spark, root))


def _state(spark: SparkSession, root: str) -> DataFrame:
    """The column state of all committed versions, brought up to date first."""
    kept, last = f"{root}/columns", ledger.last_version(spark, root, feed.ENTRY)
    have = ledger.last_version(spark, kept, infer.COLUMN_STATE)
    if have < last:
        old = _kept(spark, kept, have)
        rows = feed.read_feed(spark, root).filter(F.col("version") > have)
        new = infer.merge_states(old.unionByName(infer.column_state(rows)))
        ledger.commit(new, kept, last)
    return _kept(spark, kept, max(have, last))


def _kept(spark: SparkSession, root: str, version: int) -> DataFrame:
    entries = ledger.entries(spark, root, infer.COLUMN_STATE)
    return entries.filter(F.col("version") == version).drop("version")


def read_table(spark: SparkSession, root: str, project: str, table: str) -> DataFrame:
    """One table of the feed; a column that came later is null before."""
    of = (F.col("project") == project) & (F.col("table") == table)
    return _view(spark, root, project, table, columns(spark, root).filter(of).collect())


def register_views(spark: SparkSession, root: str, project: str | None = None) -> list[str]:
    """Make every table, or those of a project, queryable as ``proj_<project>_<table>``.

    The driver handles one row per column, as the plans of the views do.
    """
    found = columns(spark, root)
    if project is not None:
        found = found.filter(F.col("project") == project)
    tables: dict[tuple[str, str], list] = {}
    for row in found.collect():
        tables.setdefault((row["project"], row["table"]), []).append(row)
    names = []
    for (owner, table), rows in sorted(tables.items()):
        name = f"proj_{owner}_{table}"
        _view(spark, root, owner, table, rows).createOrReplaceTempView(f"`{name}`")
        names.append(name)
    return names


def _view(spark: SparkSession, root: str, project: str, table: str, rows: Sequence) -> DataFrame:
    of = (F.col("project") == project) & (F.col("table") == table)
    data = feed.read_feed(spark, root).filter(of).withColumn("_doc", F.try_parse_json("data"))
    taken = {m.lower() for m in MARKS}
    shown: list[Column] = []
    for row in sorted(rows, key=lambda r: (r["since"], r["name"])):
        name = row["name"]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        shown.append(_value(row["name"], row["type"]).alias(name))
    return data.select(*shown, *[F.col(source).alias(mark) for mark, source in MARKS.items()])


def _value(name: str, type_: str) -> Column:
    """A field by its exact name; objects and arrays as their canonical text."""
    for quote in ("'", '"'):
        if name and quote not in name:
            return F.try_variant_get("_doc", f"$[{quote}{name}{quote}]", type_)
    # A path can't say other names.
    fields = F.from_json("data", "map<string,variant>")
    return F.try_variant_get(F.element_at(fields, F.lit(name)), "$", type_)
