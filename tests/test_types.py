import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import encode as en
from tidemark.functions import type_map as tm
from tidemark.functions.render import render_row
from tidemark.operators import catalog, typed


def mapped(spark, *types):
    rows = [(i, t) for i, t in enumerate(types)]
    got = tm.map_types(spark.createDataFrame(rows, "i INT, pg_type STRING")).orderBy("i").collect()
    return got


LOSSLESS = [
    ("integer", "INTEGER"), ("int4", "INTEGER"), ("bigint", "LONG"), ("boolean", "BOOLEAN"),
    ("double precision", "DOUBLE"), ("text", "STRING"), ("date", "DATE"), ("bytea", "BINARY"),
    ("numeric(10,2)", "DECIMAL(10,2)"), ("numeric(38,0)", "DECIMAL(38,0)"), ("decimal(007,02)", "DECIMAL(7,2)"),
    ("  Double   Precision ", "DOUBLE"), ("varchar(255)", "STRING"), ("timestamptz", "TIMESTAMP"),
    ("timestamp without time zone", "TIMESTAMP_NTZ"),
]
LOSSY = [
    ("jsonb", "STRING", "json-text"), ("uuid", "STRING", "uuid-text"), ("interval", "LONG", "interval-micros"),
    ("cidr", "STRING", "cidr-text"), ("inet", "STRING", "inet-text"), ("money", "DECIMAL(19,2)", "money-decimal"),
    ("numeric(40,5)", "DECIMAL(38,5)", "decimal-clamped"), ("numeric", "DECIMAL(38,18)", "decimal-default"),
    ("integer[]", "ARRAY<INTEGER>", "array-1d"), ("integer[][]", "ARRAY<ARRAY<INTEGER>>", "array-1d"),
    ("time", "STRING", "time-text"),
]


def test_lossless(spark):
    for (_, lake), row in zip(LOSSLESS, mapped(spark, *[t for t, _ in LOSSLESS]), strict=True):
        assert (row["lake_type"], row["lossy"], row["unmapped"]) == (lake, False, None)


def test_lossy(spark):
    for (_, lake, encoding), row in zip(LOSSY, mapped(spark, *[t[0] for t in LOSSY]), strict=True):
        assert (row["lake_type"], row["encoding"], row["lossy"]) == (lake, encoding, True)
        assert row["note"]


def test_notes_and_round_trip(spark):
    uuids, chars, big, json_ = mapped(spark, "uuid[]", "varchar(255)", "bigint", "jsonb")
    assert "uuid" in uuids["note"].lower() and uuids["reverse_type"] == "uuid[]"
    assert "length" in chars["note"]
    assert (big["reverse_type"], big["lossy"]) == ("bigint", False)
    assert (json_["reverse_type"], json_["lossy"]) == ("jsonb", True)


def test_refused(spark):
    types = ["some_custom_enum", "   ", "numeric(5)", "time(3)", "timestamptz(3)", "numeric(5,7)", "[]", None]
    reasons = [r["unmapped"] for r in mapped(spark, *types)]
    assert reasons == ["no_mapping", "empty_type"] + ["no_mapping"] * 3 + ["invalid_scale", "empty_type", "empty_type"]
    assert all(r["lake_type"] is None for r in mapped(spark, *types))


def test_back(spark):
    cases = [
        ("INTEGER", "integer"), ("LONG", "bigint"), ("STRING", "text"), ("DECIMAL(10,2)", "numeric(10,2)"),
        ("ARRAY<LONG>", "bigint[]"), ("MAP<STRING,STRING>", "jsonb"), ("STRUCT<a:INT>", "jsonb"),
        ("array< array<int> >", "integer[][]"), ("ARRAY<MAP<STRING,ARRAY<INT>>>", "jsonb[]"), ("geometry", None),
        ("ARRAY<INT", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i INT, lake_type STRING")
    assert [r["pg_type"] for r in tm.map_types_back(df).orderBy("i").collect()] == [p for _, p in cases]


def column(spark, name, pg_type, position=0, nullable=True):
    row = [("t", position, name, pg_type, nullable)]
    df = spark.createDataFrame(row, "table STRING, position INT, name STRING, pg_type STRING, nullable BOOLEAN")
    return catalog.descriptors(df).collect()


@pytest.mark.parametrize(
    "pg_type, type_name, json_type",
    [
        ("integer", "INT", "integer"), ("bigint", "LONG", "long"), ("jsonb", "STRING", "string"),
        ("numeric(12,4)", "DECIMAL", "decimal(12,4)"), ("interval", "LONG", "long"),
        ("timestamp with time zone", "TIMESTAMP", "timestamp"),
        ("integer[]", "ARRAY", {"type": "array", "elementType": "integer", "containsNull": True}),
    ],
)
def test_descriptor(spark, pg_type, type_name, json_type):
    row = column(spark, 'a"b', pg_type, 2, False)[0]
    field = json.loads(row["type_json"])
    assert row["type_name"] == type_name and row["position"] == 2 and row["nullable"] is False
    assert field == {"name": 'a"b', "type": json_type, "nullable": False, "metadata": {}}
    if pg_type.startswith("numeric"):
        assert (row["type_precision"], row["type_scale"]) == (12, 4)


def test_descriptor_of_unknown_type(spark):
    assert column(spark, "x", "some_enum_type") == []


def drift(spark, pg, registered, **options):
    cols = spark.createDataFrame(
        [("t", i, n, t) for i, (n, t) in enumerate(pg)], "table STRING, position INT, name STRING, pg_type STRING"
    )
    reg = spark.createDataFrame([("t", n, t) for n, t in registered], "table STRING, name STRING, registered_type STRING")
    compared = catalog.schema_drift(cols, reg, **options)
    return catalog.drift_summary(compared).first(), catalog.schema_states(compared).first()


def test_drift_cases(spark):
    same, state = drift(spark, [("id", "bigint"), ("name", "text")], [("id", "LONG"), ("name", "STRING")])
    assert same["in_sync"] and state["found"] == "in_sync" and not state["reconciled"]
    mixed, state = drift(
        spark,
        [("id", "bigint"), ("status", "text"), ("val", "bigint"), ("amount", "numeric(10,2)")],
        [("id", "LONG"), ("val", "STRING"), ("old", "STRING"), ("amount", " decimal(10,2)")],
    )
    assert (mixed["in_sync"], mixed["added"], mixed["removed"]) == (False, ["status"], ["old"])
    assert [tuple(c) for c in mixed["type_changed"]] == [("val", "STRING", "LONG")]
    assert (state["found"], state["reconciled"], state["state"]) == ("schema_drift", True, "in_sync")


def test_reconcile_of_a_table_with_an_unmapped_column(spark):
    pg = [("a", "new", "text"), *[(t, n, p) for t in "abc" for n, p in (("id", "bigint"), ("odd", "some_enum"))]]
    rows = [(t, i, n, p, True) for i, (t, n, p) in enumerate(pg)]
    cols = spark.createDataFrame(rows, "table STRING, position INT, name STRING, pg_type STRING, nullable BOOLEAN")
    had = [("a", "id", "LONG"), ("b", "id", "LONG"), ("c", "id", "LONG"), ("c", "odd", "STRING")]
    reg = spark.createDataFrame(had, "table STRING, name STRING, registered_type STRING")
    written = sorted((r["table"], r["name"]) for r in catalog.reconcile(cols, reg, partial=True).collect())
    # b is in sync but for what has no type; c is registered with a column that has none any more.
    assert written == [("a", "id"), ("a", "new"), ("c", "id")]
    assert catalog.reconcile(cols, reg).collect() == []


def test_aliases_count_only_by_default(spark):
    pg, reg = [("a", "integer"), ("d", "numeric(10,2)")], [("a", "INT"), ("d", "DECIMAL(10, 2)")]
    assert len(drift(spark, pg, reg)[0]["type_changed"]) == 2
    assert drift(spark, pg, reg, aliases_equal=True)[0]["in_sync"]


def test_unmapped_column_is_reported(spark):
    summary, state = drift(spark, [("id", "bigint"), ("e", "my_enum")], [("id", "LONG")])
    assert summary["unmapped"] == ["e"] and state["state"] == "schema_drift"


def test_history_numbers_changes_only(spark):
    lists = {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "c"], 5: ["a", "c"]}
    rows = [("t", s, i, n, "text") for s, names in lists.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "table STRING, snapshot INT, position INT, name STRING, pg_type STRING")
    for cuts in (None, 1, 100):
        got = catalog.schema_history(df, cuts=cuts).orderBy("snapshot").collect()
        assert [r["schema_version"] for r in got] == [1, 1, 2, 3, 3]


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t STRING").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, micros",
    [
        ("1 year 2 mons 3 days 04:05:06.789", 36561906789000), ("-00:00:01", -1000000), ("2 mons", 5184000000000),
        ("1 day -02:00:00", 79200000000), ("P1Y2M3DT4H5M6.789S", 36561906789000), ("PT-0.5S", -500000),
        ("1500", 1500), ("", None), ("P", None), ("soon", None), (None, None), ("-1 days", -86400000000),
    ],
)
def test_interval(spark, text, micros):
    assert one(spark, text, en.interval_micros) == micros
    back = one(spark, text, lambda c: en.interval_micros(en.interval_text(en.interval_micros(c))))
    assert back == micros


@pytest.mark.parametrize(
    "text, amount",
    [("$1,234.50", "1234.50"), ("($1,234.50)", "-1234.50"), ("-$5", "-5.00"), ("12.345", "12.35"), ("€ 7.1", "7.10"),
     ("n/a", None), ("", None), ("1.2.3", None)],
)
def test_money(spark, text, amount):
    assert one(spark, text, en.money_decimal) == (None if amount is None else Decimal(amount))


def test_uuid_time_and_arrays(spark):
    plain = "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    for text in (plain.upper(), "{" + plain + "}", plain.replace("-", "")):
        assert one(spark, text, en.uuid_text) == plain
    assert one(spark, "1234", en.uuid_text) is None
    assert one(spark, "04:05:06.7", en.time_text) == "04:05:06.7" and one(spark, "25:00", en.time_text) is None
    ints = {"{1,2,NULL}": [1, 2, None], "[1,2]": [1, 2], "[[1],[2,3]]": [1, 2, 3], "{{1,2},{3,4}}": [1, 2, 3, 4], "{}": [], "1": None}
    for text, want in ints.items():
        assert one(spark, text, lambda c: en.array_1d(c, "INT")) == want
    assert one(spark, '{"a,b",c,NULL,"NULL"}', lambda c: en.array_1d(c, "STRING")) == ["a,b", "c", None, "NULL"]


def test_elements_are_coded_as_their_type(spark):
    """Every dimension, the element's own encoding, JSON and literal forms, quotes, escapes and odd spaces."""
    cases = [
        ("integer[][]", "{{1,2},{NULL,3}}", [[1, 2], [None, 3]]),
        ("integer[][]", "[[1,2],null,[]]", [[1, 2], None, []]),
        ("integer[][]", "{1, 2}", [[1, 2]]),  # fewer dimensions than declared
        ("integer[]", "{{{1},{2}},{{3},{4}}}", [1, 2, 3, 4]),
        ("integer[][]", "{{{1},{2}},{{3},{4}}}", [[1, 2], [3, 4]]),
        ("interval[]", '{"1 day","00:00:01.5",NULL,soon}', [86400000000, 1500000, None, None]),
        ("money[]", '{"$1,234.50","($2.00)"}', [Decimal("1234.50"), Decimal("-2.00")]),
        ("bytea[]", r'{"\\x00ff",NULL}', [bytearray(b"\x00\xff"), None]),
        ("bytea[]", r'["\\x00ff"]', [bytearray(b"\x00\xff")]),
        ("uuid[]", "{A0EEBC999C0B4EF8BB6D6BB9BD380A11}", ["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"]),
        ("jsonb[]", r'{"{\"b\": 1, \"a\": [2]}"}', ['{"a":[2],"b":1}']),
        ("jsonb[]", '[{"b": 1, "a": "x,y"}, [1]]', ['{"a":"x,y","b":1}', "[1]"]),
        ("text[]", r'{"a\"b","c\\d", e f ,"NULL","","{x,y}"}', ['a"b', "c\\d", "e f", "NULL", "", "{x,y}"]),
        ("numeric(4,1)[]", "{1.25,x,-3}", [Decimal("1.3"), None, Decimal("-3.0")]),
        ("boolean[]", "{t,f,true,NULL}", [True, False, True, None]),
        ("text[][][]", "{{{a}}}", [[["a"]]]),
        ("integer[]", "{}", []), ("integer[][]", "{}", [[]]), ("integer[]", "nope", None), ("integer[]", None, None),
    ]
    for pg_type, text, want in cases:
        feed = spark.createDataFrame([(json.dumps({"c": text}) if text is not None else "{}",)], "data STRING")
        assert typed.typed_feed(feed, [("c", pg_type)]).first()["c"] == want, (pg_type, text)


def test_report_compares_values_not_spellings(spark):
    same = [
        ("double precision", "1.50"), ("double precision", "1e3"), ("double precision", "-0.0"), ("real", "+2.5"), ("integer", "007"),
        ("numeric(10,2)", "12.3400"), ("numeric", "1.10"), ("numeric(40,5)", "-7"), ("timestamptz", "2024-01-01T00:00:00Z"),
        ("timestamptz", "2024-01-01 00:00:00.1234560+02"), ("timestamp", "2024-01-01T10:00:00"), ("date", "2024-01-01"),
        ("date", "2024-01-01 00:00:00"), ("jsonb", '{"b": 1, "a": 2}'), ("boolean", "t"), ("money", "$1,234.50"), ("text", " x "),
        ("uuid", "{A0EEBC999C0B4EF8BB6D6BB9BD380A11}"), ("interval", "1 day 00:00:01.500000"), ("numeric(4,1)[]", "{1.20,-3}"),
    ]
    lost = [
        ("numeric", "1.1234567890123456789"), ("numeric(38,2)", "1" * 30 + ".239"), ("numeric(10,2)", "0.001"),
        ("double precision", "0.1234567890123456789012"), ("double precision", "123456789012345678901"), ("real", "0.123456789"),
        ("timestamptz", "2024-01-01 00:00:00.1234567Z"), ("timestamp", "2024-01-01 10:00:00+02"), ("date", "2024-01-01 10:00:00"),
        ("money", "$1.239"), ("numeric(4,1)[]", "{1.2,NULL,1.25}"), ("numeric(4,1)[][]", "{{1.2},{1.25}}"),
    ]
    for cases, want in ((same, 0), (lost, 1)):
        columns = [(f"c{i}", t) for i, (t, _) in enumerate(cases)]
        data = json.dumps({f"c{i}": x for i, (_, x) in enumerate(cases)})
        for r in typed.cast_report(spark.createDataFrame([(data,)], "data STRING"), columns).collect():
            case = cases[int(r["name"][1:])]
            assert (r["present"], r["nulled"], r["altered"]) == (1, 0, want), case


def test_encode_by_type(spark):
    def enc(text, encoding, lake, **kw):
        return one(spark, text, lambda c: en.encode(c, encoding, lake, **kw))

    assert enc('{"b": 1, "a": 2}', "json-text", "STRING", pg_type="jsonb") == '{"a":2,"b":1}'
    assert enc('{"b": 1, "a": 2}', "json-text", "STRING", pg_type="json") == '{"b": 1, "a": 2}'
    assert enc("9" * 40, "decimal-clamped", "DECIMAL(38,5)") is None
    assert enc("1.5", "native", "INTEGER") is None and enc("7", "native", "INTEGER") == 7
    assert enc("2001-01-01 12:00:00+02", "utc-instant", "TIMESTAMP").hour in (10,)
    assert enc("1000", "utc-instant", "TIMESTAMP", epoch_unit="millis").second == 1
    assert enc("1", "native", "DATE", epoch_unit="millis") == dt.date(1970, 1, 2)
    assert enc("YWI=", "native", "BINARY") == bytearray(b"ab")
    with pytest.raises(ValueError):
        en.encode(F.lit("x"), "unheard-of", "STRING")


def test_typed_feed_and_report(spark):
    rows = [('{"id":1,"amount":"12.345","tags":[1,2]}',), ('{"id":2,"amount":"abc"}',), ('{"id":3,"amount":"1.20"}',)]
    feed = spark.createDataFrame(rows, "data STRING")
    columns = [("id", "bigint"), ("amount", "numeric(10,2)"), ("tags", "integer[]")]
    got = typed.typed_feed(feed, columns).orderBy("id").collect()
    assert [r["amount"] for r in got] == [Decimal("12.35"), None, Decimal("1.20")] and got[0]["tags"] == [1, 2]
    report = {r["name"]: (r["present"], r["nulled"], r["altered"]) for r in typed.cast_report(feed, columns).collect()}
    assert report == {"id": (3, 0, 0), "amount": (3, 1, 1), "tags": (1, 0, 0)}
    with pytest.raises(ValueError):
        typed.typed_feed(feed, [("id", "my_enum")])


def test_render(spark):
    df = spark.sql(
        "SELECT CAST(1.50 AS DECIMAL(6,2)) d, DATE'2020-01-02' day, TIMESTAMP_NTZ'2020-01-02 03:04:05' a, "
        "TIMESTAMP'2020-01-02 03:04:05.000006' b, X'61FF62' bytes, 7 n"
    )
    assert tuple(render_row(df).first()) == (
        "1.50", "2020-01-02", "2020-01-02T03:04:05", "2020-01-02T03:04:05.000006+00:00", "a�b", 7
    )
