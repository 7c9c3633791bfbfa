"""Kafka, JDBC and Delta, for clusters that have their packages.

None of the three is on the local classpath, so only the building of options and
statements is tested here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_options(
    servers: str, pattern: str = r"cdc\..*", max_offsets_per_trigger: int | None = None
) -> dict[str, str]:
    """All topics of a pattern, also later ones, from their first message."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": pattern,
        "startingOffsets": "earliest",
        # New topics are seen at the next refresh of the topic list.
        "kafka.metadata.max.age.ms": "5000",
        "failOnDataLoss": "true",
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, servers: str, **options) -> DataFrame:
    """A stream of messages in the form the operators take."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, **options)).load()
    return raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def jdbc_options(
    url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64
) -> dict[str, str]:
    """Read a table in ranges of a numeric key, one task and connection each."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if key and bounds:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def catalog_tables(spark: SparkSession, url: str) -> dict[str, DataFrame]:
    """The database's catalogue, for ``operators.catalog.column_catalog``."""
    queries = {
        "attributes": "SELECT attrelid::bigint, attnum::int, attname::text, attnotnull, attisdropped, "
        "format_type(atttypid, atttypmod) AS format_type FROM pg_attribute",
        "classes": "SELECT oid::bigint, relname::text, relnamespace::bigint FROM pg_class",
        "namespaces": "SELECT oid::bigint, nspname::text FROM pg_namespace",
        "indexes": "SELECT indrelid::bigint, indkey::int[], indisprimary FROM pg_index",
    }
    return {name: read_jdbc(spark, url, f"({sql}) AS t") for name, sql in queries.items()}


def upsert_statement(table: str, keys: Sequence[str], columns: Sequence[str]) -> str:
    """One statement per row: insert, or update the given columns of the key."""
    names = ", ".join(f'"{c}"' for c in columns)
    marks = ", ".join("?" for _ in columns)
    target = ", ".join(f'"{k}"' for k in keys)
    sets = ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in columns if c not in keys)
    action = f"DO UPDATE SET {sets}" if sets else "DO NOTHING"
    return f"INSERT INTO {table} ({names}) VALUES ({marks}) ON CONFLICT ({target}) {action}"


def delete_statement(table: str, keys: Sequence[str]) -> str:
    return f"DELETE FROM {table} WHERE " + " AND ".join(f'"{k}" = ?' for k in keys)


def write_partitions(changes: DataFrame, connect, table: str, keys: Sequence[str], batch: int = 1000) -> None:
    """Write upserts and deletes (column ``op``) through a Python driver.

    ``connect()`` opens a connection inside a task; each partition is one
    transaction. Running a partition twice leaves the same rows, as a change set
    has each key once. The statements use the driver's ``?`` marks.
    """
    columns = [c for c in changes.columns if c != "op"]
    put, remove = upsert_statement(table, keys, columns), delete_statement(table, keys)

    def run(rows) -> None:
        connection = connect()
        try:
            cursor, puts, removes = connection.cursor(), [], []

            def flush() -> None:
                if removes:
                    cursor.executemany(remove, removes)
                if puts:
                    cursor.executemany(put, puts)
                puts.clear()
                removes.clear()

            for row in rows:
                if row["op"] == "delete":
                    removes.append([row[k] for k in keys])
                else:
                    puts.append([row[c] for c in columns])
                if len(puts) + len(removes) >= batch:
                    flush()
            flush()
            connection.commit()
        finally:
            connection.close()

    changes.foreachPartition(run)


def delta_append_options(app: str, version: int) -> dict[str, str]:
    """An append that evolves the schema and is refused if it was done before."""
    return {"mergeSchema": "true", "txnAppId": app, "txnVersion": str(version)}


def delta_change_options(after: int) -> dict[str, str]:
    """The change data of a table after a version."""
    return {"readChangeFeed": "true", "startingVersion": str(after + 1)}


def delta_merge_sql(target: str, source: str, keys: Sequence[str], columns: Sequence[str]) -> str:
    """``operators.merge.apply_changes`` as one statement on a Delta table."""
    on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
    rest = [c for c in columns if c not in keys]
    sets = ", ".join(f"t.`{c}` = s.`{c}`" for c in rest)
    names = ", ".join(f"`{c}`" for c in columns)
    values = ", ".join(f"s.`{c}`" for c in columns)
    update = f"WHEN MATCHED THEN UPDATE SET {sets} " if sets else ""
    return (
        f"MERGE INTO {target} t USING {source} s ON {on} "
        f"WHEN MATCHED AND s.op = 'delete' THEN DELETE {update}"
        f"WHEN NOT MATCHED AND s.op = 'upsert' THEN INSERT ({names}) VALUES ({values})"
    )
