"""An inbox: a lake table whose every write is kept as one version of changes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import inbox
from tidemark.session import local_rows
from tidemark.sources import ledger

ENTRY = "dataset STRING, columns STRING, operation STRING, commit_ts TIMESTAMP"


@dataclass(frozen=True)
class Inbox:
    root: str
    keys: tuple[str, ...]

    def create(self, spark: SparkSession, columns: str) -> None:
        """CREATE TABLE: version 0, with an id that a re-created inbox changes."""
        declared = {f.name for f in StructType.fromDDL(columns).fields}
        if not set(self.keys) <= declared:
            raise ValueError(f"the columns must include the key {self.keys}")
        self._commit(spark, 0, uuid.uuid4().hex, columns, "create")

    def _commit(self, spark, version: int, dataset: str, columns: str, operation: str) -> None:
        row = local_rows(spark, [(dataset, columns, operation)], "dataset STRING, columns STRING, operation STRING")
        ledger.commit(row.withColumn("commit_ts", F.current_timestamp()), self.root, version)

    def _head(self, spark: SparkSession):
        entries = ledger.entries(spark, self.root, ENTRY)
        return entries.agg(F.max_by(F.struct("version", "dataset", "columns"), "version")).first()[0]

    def version(self, spark: SparkSession) -> int:
        return self._head(spark)["version"]

    def dataset(self, spark: SparkSession) -> str:
        return self._head(spark)["dataset"]

    def changes(self, spark: SparkSession, after: int = -1, upto: int | None = None) -> DataFrame:
        """Change rows of the versions in (after, upto]; other files are pruned."""
        head = self._head(spark)
        upto = head["version"] if upto is None else min(upto, head["version"])
        schema = f"{head['columns']}, _change_type STRING, version BIGINT"
        stored = ledger.read_or_empty(spark, f"{self.root}/data", schema)
        mine = stored.filter((F.col("version") > after) & (F.col("version") <= upto))
        return mine.withColumnRenamed("version", "_commit_version")

    def rows(self, spark: SparkSession) -> DataFrame:
        return inbox.table_rows(self.changes(spark), self.keys)

    def write_changes(self, spark: SparkSession, changes: DataFrame, operation: str) -> int:
        """Commit change rows, as a statement that does several things at once gives them."""
        head = self._head(spark)
        version = head["version"] + 1
        fields = StructType.fromDDL(head["columns"]).fields
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
        out = changes.select(*typed, "_change_type")
        out.write.mode("overwrite").parquet(f"{self.root}/data/version={version}")
        self._commit(spark, version, head["dataset"], head["columns"], operation)
        return version

    def insert(self, rows: DataFrame) -> int:
        return self.write_changes(rows.sparkSession, inbox.insert_rows(rows), "insert")

    def update(self, spark: SparkSession, where: Column, assign: Mapping[str, Column]) -> int:
        return self.write_changes(spark, inbox.update_rows(self.rows(spark), where, assign), "update")

    def delete(self, spark: SparkSession, where: Column) -> int:
        return self.write_changes(spark, inbox.delete_rows(self.rows(spark), where), "delete")
