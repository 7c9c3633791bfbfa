"""Keyed tables on plain Parquet: a merge rewrites the touched buckets only.

``<root>/data/version=v/bucket=b``; each ledger entry lists the version that holds
every bucket and how far each source of changes was read, so that data and
progress are committed together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import apply_changes, observed
from tidemark.session import local_rows
from tidemark.sources import ledger

ENTRY = "bucket INT, data_version BIGINT, source STRING, source_version BIGINT"


@dataclass(frozen=True)
class KeyedTable:
    """A table of unique keys. ``buckets`` is fixed for the life of the table.

    Choose ``buckets`` so that one bucket is some hundred megabytes; the driver
    handles one ledger row per bucket and nothing else.
    """

    root: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self, rows: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in _fields(self.schema)}
        typed = [F.col(k).cast(types[k]) for k in self.keys]
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int"))

    def _newest(self, spark: SparkSession) -> tuple[int, dict[int, int], dict[str, int]]:
        """The last version, the version that holds each bucket, and the mark of each source."""
        last = ledger.last_version(spark, self.root, ENTRY)
        entry = ledger.entries(spark, self.root, ENTRY).filter(F.col("version") == last).collect()
        places = {r["bucket"]: r["data_version"] for r in entry if r["data_version"] is not None}
        marks: dict[str, int] = {}
        for r in entry:
            if r["source"]:
                marks = joined(marks, {r["source"]: r["source_version"]})
        return last, places, marks

    def progress(self, spark: SparkSession, source: str) -> int:
        """How far ``source`` was applied, -1 if never: a new source starts anew."""
        return self.marks(spark).get(source, -1)

    def marks(self, spark: SparkSession) -> dict[str, int]:
        """How far every source was applied."""
        return self._newest(spark)[2]

    def read(self, spark: SparkSession) -> DataFrame:
        _, places, _ = self._newest(spark)
        return self._read(spark, sorted(places.items()))

    def _read(self, spark: SparkSession, places: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in places]
        if not paths:
            return local_rows(spark, [], self.schema)
        base = spark.read.schema(self.schema).option("basePath", f"{self.root}/data")
        names = [f.name for f in _fields(self.schema)]
        return base.parquet(*paths).select(*names)

    def rewrite(
        self,
        changes: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame],
        source: str = "",
        source_version: int = -1,
        counts: dict[str, int] | None = None,
        op: str = "op",
    ) -> int:
        """Commit ``combine(rows of the touched buckets, changes)``; ``counts`` takes those of ``observed``.

        The changes are staged first: that cuts their lineage, tells the touched
        buckets from file names, and runs the collapse once.
        """
        spark = changes.sparkSession
        last, held, marks = self._newest(spark)
        version = last + 1
        staged = f"{self.root}/staged/version={version}"
        if counts is not None:
            changes, seen = observed(changes, op)
        _write_buckets(self._bucket(changes), staged)
        if counts is not None:
            counts.update(seen.get)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields)
        batch = ledger.read_or_empty(spark, staged, f"{ddl}, bucket INT")
        touched = ledger.partition_values(batch, "bucket")

        current = self._read(spark, [(b, held[b]) for b in touched if b in held])
        merged = self._bucket(combine(current, batch.drop("bucket")))
        out = f"{self.root}/data/version={version}"
        _write_buckets(merged, out)

        present = ledger.read_or_empty(spark, out, f"{self.schema}, bucket INT")
        filled = ledger.partition_values(present, "bucket")
        places = {b: v for b, v in held.items() if b not in touched}
        places |= {b: version for b in filled}
        # A merge without a source leaves every mark as it was, and no mark goes back.
        if source:
            marks = joined(marks, {source: source_version})
        rows = [(b, v, None, None) for b, v in sorted(places.items())]
        rows += [(None, None, s, v) for s, v in sorted(marks.items())]
        # An emptied table without sources still has an entry.
        rows = rows or [(None, None, None, None)]
        ledger.commit(local_rows(spark, rows, ENTRY), self.root, version)
        return version

    def merge_counted(
        self, changes: DataFrame, source: str = "", source_version: int = -1, op: str = "op"
    ) -> dict[str, int]:
        """``merge``, with how many upserts and deletes it applied.

        The counts come from the pass that stages the changes.
        """
        counts: dict[str, int] = {}
        version = self._merge(changes, source, source_version, op, counts)
        return {"version": version} | counts

    def merge(self, changes: DataFrame, source: str = "", source_version: int = -1, op: str = "op") -> int:
        """Apply upserts and deletes (column ``op``), at most one per key."""
        return self._merge(changes, source, source_version, op, None)

    def _merge(self, changes: DataFrame, source: str, source_version: int, op: str, counts: dict[str, int] | None) -> int:
        def combine(rows: DataFrame, new: DataFrame) -> DataFrame:
            return apply_changes(rows, new, self.keys, op)

        return self.rewrite(changes, combine, source, source_version, counts, op)


def joined(marks: Mapping[str, int], others: Mapping[str, int]) -> dict[str, int]:
    """The marks of both: the higher one of each source, in whatever order they are joined."""
    return {s: max(marks.get(s, -1), others.get(s, -1)) for s in {*marks, *others}}


def _write_buckets(rows: DataFrame, path: str) -> None:
    """Few files per bucket, whatever the number of tasks that hold its rows."""
    sized = rows.hint("rebalance", "bucket")
    sized.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields
