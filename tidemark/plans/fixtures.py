"""Inputs of the registered queries, derived from the given tables.

See FIXTURES.md. Each one is a projection, union or aggregation of whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json_text import has_data_field
from tidemark.functions.type_map import map_types
from tidemark.operators import envelope
from tidemark.session import new_work_folder

ACCOUNT_COLUMNS = "user_id BIGINT, value STRING, props STRING, extra STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use every core for the JSON work on inputs of fewer files than cores.

    A table of many files already has more scan tasks and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived messages as the files of a log, written once per application.

    Queries over messages then scan plain columns, as they would from a topic.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        path = new_work_folder(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"))
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        "props",
        op.alias("op"),
        millis("ts").alias("ts_ms"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("amount"),
        (F.col("event_type") == "error").cast("string").alias("deleted"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("project"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _text(*parts: str | Column) -> Column:
    """Literals and columns by turns, joined to one text."""
    return F.concat(*[F.lit(p) if i % 2 == 0 else p for i, p in enumerate(parts)])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A. Change messages, a few of them malformed."""
    return _timed_messages(spark, sf_dir).drop("ts")


def _timed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "messages", _build_messages)


def _build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _account_events(spark, sf_dir)
    other = F.concat(F.lit("p"), (F.col("user_id") + 1) % 3)
    owner = F.when(_every(97), other).otherwise(F.col("project"))
    topic = F.concat(F.lit("cdc."), "project", F.lit(".proj_"), owner, F.lit(".accounts"))
    data = _text('"user_id":', "user_id", ',"value":"', "amount", '","props":', "props")
    marks = _text('"__ts_ms":', "ts_ms", ',"__deleted":"', "deleted", '"')
    op = _text('"__op":"', "op", '"')
    extra = _text('"extra":"x', F.col("event_id") % 5, '"')

    def obj(*parts: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    value = (
        F.when(_every(97), obj(data, op, marks))
        .when(_every(89), F.lit(None).cast("string"))
        .when(_every(83), obj(op, marks))
        .when(_every(79), obj(data, marks))
        .when(_every(73), obj(data, extra, op, marks))
        .when(_every(71), F.concat(F.lit("{"), data))
        .otherwise(obj(data, op, marks))
    )
    return ev.select(topic.alias("topic"), "partition", "offset", value.alias("value"), "ts")


def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A, before flattening: events with the old and the new row."""
    return landed(spark, sf_dir, "nested", _build_nested)


def _build_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _account_events(spark, sf_dir)
    row = _text('{"user_id":', "user_id", ',"value":"', "amount", '","props":', "props", "}")
    null = F.lit("null")
    before = F.when(F.col("op") == "c", null).otherwise(row)
    after = F.when(F.col("op") == "d", null).otherwise(row)
    event = _text('{"before":', before, ',"after":', after, ',"op":"', "op", '","ts_ms":', "ts_ms", "}")
    return ev.select(
        F.concat(F.lit("cdc."), "project", F.lit(".proj_"), "project", F.lit(".accounts")).alias("topic"),
        "partition",
        "offset",
        F.when(~_every(89), event).alias("value"),
    )


# C. Ties within one version are ordered by these after deletes.
CHANGE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def inbox_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C. Change rows of an inbox keyed by order, one version per ship date."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "insert").when(flag == "N", "update_postimage").otherwise("delete")
    before = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 101 != 0, F.col("l_orderkey")).alias("l_orderkey"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("l_extendedprice"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("_commit_version"),
        F.when(before, "update_preimage").otherwise(kind).alias("_change_type"),
    )


def order_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D. An operational table for the changes of C."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("l_extendedprice"),
        F.lit(None).cast("bigint").alias("l_partkey"),
    )


# D. Versions are microseconds: 1998-01-01 of the rows, 1996-01-01 of the ledger.
ROW_VERSION = 883612800000000
LEDGER_VERSION = 820454400000000


def account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")
    )


def account_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = account_rows(spark, sf_dir).filter(F.col("c_custkey") % 3 != 0)
    return rows.withColumn("version", F.lit(ROW_VERSION))


def account_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 5 == 0)
    return keys.select("c_custkey", F.lit(LEDGER_VERSION).alias("lake_version"))


def lake_changes(spark: SparkSession, sf_dir: str, unversioned: bool = False) -> DataFrame:
    """D. Lake-side changes of the accounts; some without a version."""
    version = micros("o_orderdate")
    if unversioned:
        version = F.when(F.col("o_orderkey") % 50 != 0, version)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("c_acctbal"),
        F.col("o_orderpriority").alias("note"),
        version.alias("version"),
    )


def hot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D. The changes with two thirds of them on one account, in an order with ties, nulls and NaN."""
    seq = F.col("seq")
    at = F.when(seq % 7 == 0, F.lit(None)).when(seq % 11 == 0, float("nan")).otherwise((seq % 100) / 4)
    rows = lake_changes(spark, sf_dir, unversioned=True)
    hot = F.when(seq % 3 != 0, F.lit(1).cast("bigint")).otherwise(F.col("c_custkey"))
    return rows.withColumns({"c_custkey": hot, "at": at.cast("double")})


def shop_deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """B. Two tables of a project in two deliveries; the second brings columns the first has not.

    A column ``memo`` is null in every message.
    """
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    price, balance = (F.col(c).cast("decimal(18,2)") for c in ("o_totalprice", "c_acctbal"))
    order = [key.alias("id"), F.col("o_custkey").alias("cust"), price.alias("total"), F.col("o_orderstatus").alias("op")]
    nested = F.struct(F.col("o_orderpriority").alias("p"), F.array(key, F.lit(1)).alias("n")).alias("tags")
    late = [key.cast("string").alias("version"), (key % 5 == 0).alias("offset"), nested]
    customer = [cust.alias("id"), F.col("c_name").alias("name")]
    memo, marks = F.lit(None).cast("string").alias("memo"), [F.lit("c").alias("__op"), F.lit(0).alias("__ts_ms")]

    def sent(rows: DataFrame, name: str, offset: Column, columns: list[Column]) -> DataFrame:
        return rows.select(
            F.lit(f"cdc.shop.proj_shop.{name}").alias("topic"),
            F.lit(0).alias("partition"),
            offset.cast("bigint").alias("offset"),
            F.to_json(F.struct(*columns, memo, *marks), {"ignoreNullFields": "false"}).alias("value"),
        )

    return [
        sent(orders.filter(key % 2 == 0), "orders", key, order).unionByName(
            sent(customers.filter(cust % 3 != 0), "customers", cust, customer)
        ),
        sent(orders.filter(key % 2 == 1), "orders", key, order + late).unionByName(
            sent(customers.filter(cust % 3 == 0), "customers", cust, [*customer, balance.alias("balance")])
        ),
    ]


def second_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D. The accounts later on: some gone, some changed, some new."""
    rows = account_rows(spark, sf_dir)
    key = F.col("c_custkey")
    raised = F.when(key % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    kept = rows.filter(key % 7 != 0).withColumn("c_acctbal", raised.cast("decimal(18,2)"))
    new = rows.filter(key % 13 == 0).withColumn("c_custkey", key + 1_000_000)
    return kept.unionByName(new)


# E. Type names of the catalogue's columns, by turns.
PG_TYPES = (
    "boolean", "bool", "smallint", "int2", "integer", "int", "int4", "bigint", "int8", "real", "float4",
    "double precision", "float8", "text", "date", "bytea", "jsonb", "json", "uuid", "interval", "cidr",
    "inet", "macaddr", "money", "tsvector", "numeric(10,2)", "decimal ( 12 , 4 )", "numeric(38,0)",
    "numeric(40,5)", "numeric(50,45)", "numeric", "decimal", "varchar(255)", "character varying", "char(3)",
    "bpchar", "timestamptz", "timestamp with time zone", "timestamp(3) with time zone", "timestamp",
    "timestamp (6)", "timestamp without time zone", "time", "timetz", "time with time zone",
    "time without time zone", "integer[]", "uuid[]", "integer[][]", "varchar(5) [ ]", "numeric(40,5)[]",
    "numeric(5)", "numeric(5,7)", "time(3)", "timestamptz(3)", "some_custom_enum", "some_custom_enum[]",
    "", "[]", "  Double   Precision ",
)


def column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E. A catalogue of tables with twenty columns each."""
    types = F.array(*[F.lit(t) for t in PG_TYPES])
    key = F.col("p_partkey")
    position = (key % 20).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), F.floor(key / 20).cast("bigint")).alias("table"),
        position.alias("position"),
        F.concat(F.lit("c"), position).alias("name"),
        F.element_at(types, (key % len(PG_TYPES) + 1).cast("int")).alias("pg_type"),
        (F.col("p_size") % 2 == 0).alias("nullable"),
        "p_partkey",
    )


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_rows(spark, sf_dir).drop("p_partkey")


def registered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F. What is registered of E: some columns missing, changed or left over."""
    mapped = map_types(column_rows(spark, sf_dir)).filter(F.col("unmapped").isNull())
    key = F.col("p_partkey")
    text = F.when(key % 11 == 0, "STRING").otherwise(F.col("lake_type"))
    text = F.when(key % 2 == 0, F.lower(text)).otherwise(text)
    kept = mapped.filter(key % 7 != 0).select("table", "name", text.alias("registered_type"))
    legacy = column_rows(spark, sf_dir).filter(key % 13 == 0).select(
        "table",
        F.concat(F.lit("legacy_"), F.col("position")).alias("name"),
        F.lit("STRING").alias("registered_type"),
    )
    return kept.unionByName(legacy)


def catalog_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F. Five snapshots of E: the first 10 columns of each table twice, 15 of them, and all columns twice."""
    rows = catalog_rows(spark, sf_dir)
    width = F.when(F.col("snapshot") < 3, 10).when(F.col("snapshot") == 3, 15)
    every = rows.withColumn("snapshot", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    return every.filter(width.isNull() | (F.col("position") < width))


def database_catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """E, as the four catalogue tables of the database itself."""
    rows = column_rows(spark, sf_dir)
    oid = F.floor(F.col("p_partkey") / 20).cast("bigint")
    columns = rows.select(
        oid.alias("attrelid"),
        (F.col("position") + 1).alias("attnum"),
        F.col("name").alias("attname"),
        F.col("pg_type").alias("format_type"),
        (~F.col("nullable")).alias("attnotnull"),
        (F.col("position") == 19).alias("attisdropped"),
    )
    first = rows.filter(F.col("position") == 0)
    system = first.select(
        oid.alias("attrelid"), F.lit(-1).alias("attnum"), F.lit("ctid").alias("attname"),
        F.lit("tid").alias("format_type"), F.lit(True).alias("attnotnull"), F.lit(False).alias("attisdropped"),
    )
    classes = first.select(
        oid.alias("oid"), F.col("table").alias("relname"), (oid % 3).alias("relnamespace")
    )
    indexes = first.select(
        oid.alias("indrelid"),
        F.when(oid % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("indkey"),
        F.lit(True).alias("indisprimary"),
    )
    namespaces = classes.select(
        F.col("relnamespace").alias("oid"), F.concat(F.lit("proj_p"), F.col("relnamespace")).alias("nspname")
    ).distinct()
    return {
        "attributes": columns.unionByName(system),
        "classes": classes,
        "namespaces": namespaces,
        "indexes": indexes,
    }


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G. Object keys of a bucket; a third of them are data files."""
    doc = F.col("doc_id")
    suffix = F.when(doc % 40 >= 30, "_inbox").otherwise("")
    folder = F.concat(F.lit("p"), doc % 5, F.lit("/t"), doc % 40, suffix)
    log = F.concat(folder, F.lit("/_delta_log/"), doc, F.lit(".json"))
    data = F.concat(folder, F.lit("/part-"), doc, F.lit(".parquet"))
    key = F.when(doc % 3 == 0, data).otherwise(log)
    return table(spark, sf_dir, "documents").select(key.alias("key"))


def registered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G. Registered tables: some of the stored ones, and some long gone."""
    doc = F.col("doc_id")
    some = table(spark, sf_dir, "documents").filter((doc % 4 != 0) & (doc % 40 < 30)).select(
        F.concat(F.lit("p"), doc % 5).alias("project"), F.concat(F.lit("t"), doc % 40).alias("table")
    )
    gone = table(spark, sf_dir, "documents").filter(doc % 50 == 0).select(
        F.concat(F.lit("p"), doc % 50 + 9).alias("project"), F.concat(F.lit("t"), doc % 100).alias("table")
    )
    names = some.unionByName(gone).distinct()
    return names.select(
        F.concat(F.lit("proj_"), "project").alias("schema"), "table", F.concat_ws("/", "project", "table").alias("location")
    )


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H. Raw texts of every encoding, made from the orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    clock = F.concat(
        F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"),
        F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"),
    )
    thousands = F.floor(cents / 100_000).cast("bigint")
    below = F.lpad((F.floor(cents / 100) % 1000).cast("bigint").cast("string"), 3, "0")
    money = F.concat(
        F.lit("$"), thousands, F.lit(","), below, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    hexa = F.md5(k.cast("string"))
    uuid = F.concat_ws(
        "-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4),
        F.substring(hexa, 17, 4), F.substring(hexa, 21, 12),
    )
    cases = (
        ("interval-micros", F.concat(k % 5, F.lit(" years "), k % 12, F.lit(" mons "), k % 40, F.lit(" days "), clock, F.lit(".5"))),
        ("interval-micros", F.concat(F.lit("-"), clock)),
        ("interval-micros", F.concat(F.lit("P"), k % 40, F.lit("DT"), k % 24, F.lit("H"), k % 60, F.lit(".25S"))),
        ("money-decimal", money),
        ("money-decimal", F.concat(F.lit("("), money, F.lit(")"))),
        ("uuid-text", F.concat(F.lit("{"), F.upper(uuid), F.lit("}"))),
        ("json-text", F.concat(F.lit('{"b": '), k, F.lit(', "a": ['), c, F.lit("]}"))),
        ("decimal-clamped", F.concat(k, F.repeat(F.lit("7"), (k % 40).cast("int")), F.lit(".125"))),
        ("decimal-default", F.concat(c, F.lit(".1234567890123456789"))),
        ("utc-instant", F.concat(F.lit("2001-02-03 "), clock, F.lit("+02"))),
        ("time-text", F.concat(F.lit(" "), clock, F.lit(".25"))),
        ("array-1d", F.concat(F.lit("{{"), k, F.lit(","), c, F.lit("},{NULL,7}}"))),
        ("interval-micros", F.lit("soon")),
        ("money-decimal", F.lit("n/a")),
        ("uuid-text", F.lit("1234")),
        ("json-text", F.concat(F.lit('{"b": '), k)),
        ("decimal-clamped", F.lit("abc")),
        ("utc-instant", F.lit("yesterday")),
        ("time-text", F.lit("25:00")),
        ("array-1d", F.lit("1,2")),
    )
    kind = (k % len(cases)).cast("int")
    encoding, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, text) in enumerate(cases):
        encoding = F.when(kind == i, name).otherwise(encoding)
        raw = F.when(kind == i, text).otherwise(raw)
    orders = spread(table(spark, sf_dir, "orders"))
    return orders.select("o_orderkey", kind.alias("kind"), encoding.alias("encoding"), raw.alias("raw"))


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B. The ledger of a feed that took A in one version per three days."""
    data = F.coalesce(has_data_field(F.col("value")), F.lit(False))
    three_days = 3 * 86_400_000_000
    return _timed_messages(spark, sf_dir).groupBy(
        F.floor(micros("ts") / three_days).cast("bigint").alias("version"), "topic", "partition"
    ).agg(
        F.max("offset").alias("max_offset"),
        F.count_if(F.col("topic").rlike(envelope.topic_pattern()) & data).alias("rows"),
        F.max(F.col("ts").cast("timestamp")).alias("commit_ts"),
    )
