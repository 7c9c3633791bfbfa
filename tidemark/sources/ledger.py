"""Commits of plain Parquet datasets.

Data goes to ``<root>/data/version=v`` and becomes visible once the one-file
ledger entry ``<root>/ledger/version=v`` exists. One writer per root: versions
are given out as last + 1, so a version left half-written by a crash is
overwritten by the retry, and every version up to the last committed one is whole.
With a transactional table format on the cluster use ``adapters`` instead.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import local_rows


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dataset with a declared schema, empty before the first write."""
    if not _exists(spark, path):
        return local_rows(spark, [], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return local_rows(spark, [], schema)
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system, so that no query fails where listeners are told of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def entries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/ledger", f"version BIGINT, {schema}")


def partition_values(stored: DataFrame, column: str) -> set[int]:
    """The values of an integer partition column, from the names of the files.

    Needs no job: Spark has listed the files to plan the read.
    """
    names = (re.search(rf"/{column}=(\d+)/", path) for path in stored.inputFiles())
    return {int(m.group(1)) for m in names if m}


def last_version(spark: SparkSession, root: str, schema: str) -> int:
    """The last committed version, -1 before the first commit."""
    return max(partition_values(entries(spark, root, schema), "version"), default=-1)


def commit(entry: DataFrame, root: str, version: int) -> None:
    """Make a version visible. One file, so that the entry is all or nothing.

    Its rows are shuffled to the task that writes it, which computes none of them.
    """
    entry.repartition(1).write.mode("overwrite").parquet(f"{root}/ledger/version={version}")
