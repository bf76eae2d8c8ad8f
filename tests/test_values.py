"""Types, parsers, schemas, rows, display and tools."""

import datetime as dt
import decimal
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import display, faker, logs, row, tools
from tabulon.functions import parse as P
from tabulon.schema import ColumnDefinitionError, DataError, DataValidationError, ExcessColumnsInDataError, FlatColumn, RelationSchema, statistics
from tabulon.types import NAMES, LogicalType, from_arrow, parse_type, promote

MOMENT = dt.datetime(2021, 1, 11, 12)
CASTS = [
    ("BOOLEAN", ["true", "Yes", "on", "1.0", "t", "no", "abc", " 1", None], [True, True, True, True, True, False, False, False, None]),
    ("INTEGER", ["42", " -7 ", "0042", "42.9", "x", None], [42, -7, 42, None, None, None]),
    ("DOUBLE", ["1.5", " 2 ", "1.23e5", "-inf", "x", None], [1.5, 2.0, 123000.0, float("-inf"), None, None]),
    ("DECIMAL(10,2)", ["2.675", "2.665", "-1", "x", "123456789012"], [decimal.Decimal("2.68"), decimal.Decimal("2.66"), decimal.Decimal("-1.00"), None, None]),
    ("VARCHAR[5]", ["hello world", "ééé", "", None], ["hello", "éé", "", None]),
    ("BLOB[3]", ["hello", "é"], [b"hel", "é".encode()]),
    ("TIMESTAMP", ["2021-01-11 12:00", "2021-01-11T12:00Z", "2021-01-11 12:00+0100", "2021-01-11T12:00:00.999+0800", "1610366400", "2021-02-30", "2021-02-21T", "nonsense", "2021"], [MOMENT, MOMENT, MOMENT, MOMENT, MOMENT, None, None, None, dt.datetime(1970, 1, 1, 0, 33, 41)]),
    ("DATE", ["2024-02-29", "2023-02-29", "2023-04-18 12:12:12"], [dt.date(2024, 2, 29), None, dt.date(2023, 4, 18)]),
    ("TIME", ["12:34:56", "2021-01-11 12:34:56", "25:00:00"], ["12:34:56", "12:34:56", None]),
    ("ARRAY<INTEGER>", ["[1, 2]", "[]", None], [[1, 2], [], None]),
    ("VECTOR", ["[1, 2.5]"], [[1.0, 2.5]]),
]


@pytest.mark.parametrize("kind,texts,want", CASTS, ids=[c[0] for c in CASTS])
def test_parsers(spark, kind, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", P.parse(F.col("t"), kind, T.StringType()).alias("v")).orderBy("i").collect()]
    assert [bytes(g) if isinstance(g, bytearray) else g for g in got] == want


def test_typed_values_and_strict(spark):
    df = spark.range(1).select(F.lit(True).alias("b"), F.lit(42.9).alias("f"), F.lit(1_681_776_600).alias("n"), F.lit(b"on").alias("y"))
    r = df.select(P.varchar(F.col("b"), None, T.BooleanType()).alias("b"), P.integer(F.col("f"), T.DoubleType()).alias("f"), P.timestamp(F.col("n"), T.IntegerType()).alias("n"), P.boolean(F.col("y"), T.BinaryType()).alias("y")).first()
    assert (r.b, r.f, r.n, r.y) == ("True", 42, dt.datetime(2023, 4, 18, 0, 10), True)
    with pytest.raises(Exception, match="not a valid"):
        spark.createDataFrame([("x",)], "t string").select(P.parse(F.col("t"), "DATE", T.StringType(), strict=True)).collect()


def test_grammar():
    for text in ("INTEGER", "VARCHAR[12]", "BLOB[3]", "DECIMAL(10,2)", "ARRAY<INTEGER>", "ARRAY<DECIMAL(5,2)>", "VECTOR[64]"):
        assert str(parse_type(text)) == text
    assert parse_type("list").element == LogicalType("VARCHAR") and parse_type("numeric(4, 1)").scale == 1
    for bad in ("", "INTEGERS", "VARCHAR[x]", "DECIMAL(40,2)", "DECIMAL(3,5)", "ARRAY<ARRAY<INTEGER>>", "INTEGER[3]", "VARCHAR[3] junk"):
        with pytest.raises(ValueError):
            parse_type(bad)
    assert all(LogicalType(n).metadata["name"] == n for n in NAMES)
    with pytest.raises(ValueError):
        from_arrow(pa.dictionary(pa.int32(), pa.string()))


@pytest.mark.parametrize("types,want", [([], "NULL"), (["BOOLEAN", "INTEGER"], "INTEGER"), (["DECIMAL", "DOUBLE"], "DECIMAL"), (["DATE", "TIMESTAMP"], "TIMESTAMP"), (["BLOB", "VARCHAR"], "VARCHAR"), (["VECTOR", "ARRAY"], "ARRAY"), (["STRUCT", "VARCHAR"], "BLOB"), (["BLOB", "INTEGER"], "BLOB"), (["INTEGER", "VARCHAR"], "VARCHAR"), (["NULL", "DATE"], "DATE")])
def test_promotion(types, want):
    assert promote(types).name == want


def test_schema(spark):
    s = RelationSchema("t", [FlatColumn("a", "INTEGER", nullable=False), FlatColumn("b", "VARCHAR", aliases=("bee",), default="x")])
    assert s.validate({"a": 1, "b": None})
    with pytest.raises(ExcessColumnsInDataError):
        s.validate({"a": 1, "b": "", "c": 2})
    with pytest.raises(DataValidationError) as e:
        s.validate({"a": None, "b": 5})
    assert set(e.value.errors) == {"a", "b"}
    with pytest.raises(TypeError):
        s.validate([1])
    with pytest.raises(ColumnDefinitionError):
        FlatColumn.of(type="INTEGER")
    assert s.find_column("BEE", True).name == "b" and s.column(0).name == "a" and len((s + s).columns) == 2
    back = RelationSchema.from_dict(s.to_dict())
    assert back.same_shape(s) and FlatColumn.from_json(s.columns[1].to_json()).aliases == ("bee",)
    assert RelationSchema.from_arrow(s.arrow()).same_shape(s) and s.arrow(True).names == [c.identity for c in s]
    df = spark.createDataFrame([(1, "p"), (None, None)], "a long, b string")
    assert [len(r[0]) for r in df.select(s.errors()).collect()] == [0, 1]
    with pytest.raises(Exception, match="not Nullable"):
        s.check(df).collect()
    assert s.with_defaults(df).collect()[1].b == "x"
    assert [tuple(r) for r in statistics(df).collect()] == [("a", "1", "1", 1), ("b", "p", "p", 1)]
    assert s.pop_column("b").name == "b" and s.pop_column("zz") is None
    with pytest.raises(TypeError):
        FlatColumn("a").materialize()


def test_rows():
    kind = row.Row.make(["a", "b", "c"])
    r = kind({"a": 1, "c": dt.datetime(2020, 1, 2), "z": 3})
    assert r == (1, None, dt.datetime(2020, 1, 2)) and r.get("zz", 4) == 4 and r.as_dict["b"] is None
    assert kind.from_bytes(r.to_bytes()) == r and r.as_json.startswith('{"a":1,"b":null')
    with pytest.raises(DataError):
        kind.from_bytes(r.to_bytes()[:-1])
    with pytest.raises(DataError):
        kind(("x" * (17 << 20), 0, 0)).to_bytes()
    assert row.extract_fields({"a": 1}, ["b", "a", "a"]) == (None, 1, 1)


def test_display():
    s = RelationSchema("t", [FlatColumn("city"), FlatColumn("n", "INTEGER")])
    out = display.table(s, [("東京", 1), (None, 2)], display_width=80)
    assert "[ 2 rows x 2 columns ]" in out and len({display.wide(x) for x in out.split("\n")[:-1]}) == 1
    assert "&lt;b&gt;" in display.html(s, [("<b>", 1)]) and display.markdown(s, [("a|b", 1)]).count("\n") == 2
    assert display.span(dt.timedelta(days=1, seconds=3661.5)) == "1d 1h 1m 1.50s"


def test_tools_and_logs():
    calls = []

    @tools.retry(max_tries=3, backoff=0)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise KeyError
        return 7

    assert flaky() == 7 and len(calls) == 3

    @tools.lru_cache_with_expiry(max_size=1, valid_for_seconds=0.05)
    def cached(x):
        calls.append(x)
        return x

    n = len(calls)
    assert cached(1) == cached(1) == 1 and len(calls) == n + 1
    time.sleep(0.06)
    assert cached(1) == 1 and len(calls) == n + 2
    timed = tools.counter(lambda: None)
    timed()
    assert timed.stats["calls"] == 1 and timed.stats["fastest"] <= timed.stats["slowest"]
    assert tools.single_item_cache(lambda x: object())(1) is not None and len(tools.random_string(8)) == 8
    hidden = logs.redact({"password": "p", "at": "db://u:secretpw@h"})
    assert hidden["password"] == f"<{logs.digest('p')}>" and "secretpw" not in hidden["at"]
    logs.get_logger().audit("token=%s", "abc")


def test_faker(spark):
    s = RelationSchema("t", [FlatColumn("age", "INTEGER", disposition="AGE", nullable=False), FlatColumn("v", "DOUBLE")])
    df = faker.generate_fake_data(spark, s, 5_000, seed=1)
    r = df.agg(F.min("age"), F.max("age"), F.count("age"), F.count("v")).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] == 5_000 and 4_800 < r[3] < 5_000
    with pytest.raises(TypeError):
        faker.generate_fake_data(spark, RelationSchema("t", [FlatColumn("x", "STRUCT")]), 1)


DAY, NOON = dt.date(2023, 4, 18), dt.datetime(2023, 4, 18, 12, 34, 56)
D = decimal.Decimal
#: Logical type, Spark type of the inputs, inputs, results: every rule of every parser for every kind of input it takes.
TYPED = [
    ("BOOLEAN", "string", "true FALSE yes no on off 1 0 y n t f TRUE oN".split() + [None], [True, False] * 6 + [True, True, None]),
    ("BOOLEAN", "binary", [w.encode() for w in "true FALSE yes no on off 1 0 y n t f".split()] + [None], [True, False] * 6 + [None]),
    ("BOOLEAN", "long", [1, 0, 2, None], [True, False, False, None]),
    ("BOOLEAN", "double", [1.0, 0.0, None], [True, False, None]),
    ("BOOLEAN", "boolean", [True, False, None], [True, False, None]),
    ("BLOB", "string", ["hello", "", "特殊", None], [b"hello", b"", "特殊".encode(), None]),
    ("BLOB", "binary", [b"bytes", b"", b"\xff\x00", None], [b"bytes", b"", b"\xff\x00", None]),
    ("BLOB", "long", [123, None], [b"123", None]),
    ("BLOB", "double", [123.45], [b"123.45"]),
    ("BLOB", "boolean", [True, False], [b"True", b"False"]),
    ("BLOB", "array<string>", [["list", "item"]], [b'["list","item"]']),
    ("BLOB", "struct<key:string>", [("value",)], [b'{"key":"value"}']),
    ("BLOB[5]", "string", ["hello world", "hi"], [b"hello", b"hi"]),
    ("DATE", "string", ["2023-04-18", "2023-04-18 12:12:12", "2024-02-29", "2023-02-29", None], [DAY, DAY, dt.date(2024, 2, 29), None, None]),
    ("DATE", "binary", [b"2023-04-18", None], [DAY, None]),
    ("DATE", "date", [DAY, None], [DAY, None]),
    ("DATE", "timestamp_ntz", [NOON], [DAY]),
    ("DATE", "long", [1_681_776_000, -86_400, None], [DAY, dt.date(1969, 12, 31), None]),
    ("TIMESTAMP", "string", ["2023-04-18T12:34:56", "2023-04-18", "1681776600", None], [NOON, dt.datetime(2023, 4, 18), dt.datetime(2023, 4, 18, 0, 10), None]),
    ("TIMESTAMP", "binary", [b"2023-04-18T12:34:56"], [NOON]),
    ("TIMESTAMP", "long", [1_681_776_600, 0, -1, 253_402_300_799, 253_402_300_800, None], [dt.datetime(2023, 4, 18, 0, 10), dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(9999, 12, 31, 23, 59, 59), None, None]),
    ("TIMESTAMP", "double", [1_681_776_600.9], [dt.datetime(2023, 4, 18, 0, 10)]),
    ("TIMESTAMP", "date", [DAY], [dt.datetime(2023, 4, 18)]),
    ("DECIMAL", "string", ["123.45", " 7 ", "1e3", "x", None], [D("123.45"), D(7), D(1000), None, None]),
    ("DECIMAL", "long", [123, None], [D(123), None]),
    ("DECIMAL(5,2)", "binary", [b"123.45"], [D("123.45")]),
    ("DECIMAL(5,3)", "string", ["12.3455", "12.3465", "123.45"], [D("12.346"), D("12.346"), None]),
    *((f"DECIMAL(38,{s})", "string", ["9" * (38 - s) + ("." + "9" * s if s else ""), "-" + "9" * (38 - s), "1" + "0" * (38 - s)], [D("9" * (38 - s) + ("." + "9" * s if s else "")), D("-" + "9" * (38 - s)), None]) for s in (0, 2, 10, 21, 32, 37)),
    ("DOUBLE", "string", ["123.45", "-123.45", "1.23e5", "1.23E-5", "-inf", " 123.45 ", "000123.45000", "x", None], [123.45, -123.45, 123000.0, 0.0000123, float("-inf"), 123.45, 123.45, None, None]),
    ("DOUBLE", "binary", [b"123.45"], [123.45]),
    ("DOUBLE", "long", [123], [123.0]),
    ("DOUBLE", "double", [float("inf"), None], [float("inf"), None]),
    ("DOUBLE", "boolean", [True, False], [1.0, 0.0]),
    ("INTEGER", "string", ["42", "-42", "0042", " 42 ", "9223372036854775807", "-9223372036854775808", "9223372036854775808", "4.2", None], [42, -42, 42, 42, 2**63 - 1, -(2**63), None, None, None]),
    ("INTEGER", "binary", [b"42"], [42]),
    ("INTEGER", "double", [42.9, -42.9], [42, -42]),
    ("INTEGER", "boolean", [True, False, None], [1, 0, None]),
    ("INTEGER", "long", [2**63 - 1, -(2**63)], [2**63 - 1, -(2**63)]),
    ("VARCHAR", "string", ["hello", "", " padded ", None], ["hello", "", " padded ", None]),
    ("VARCHAR", "long", [123], ["123"]),
    ("VARCHAR", "double", [123.45], ["123.45"]),
    ("VARCHAR", "boolean", [True, False], ["True", "False"]),
    ("VARCHAR", "binary", [b"binary string"], ["binary string"]),
    ("VARCHAR", "date", [DAY], ["2023-04-18"]),
    ("VARCHAR", "timestamp_ntz", [NOON], ["2023-04-18 12:34:56"]),
    ("VARCHAR", "array<string>", [["list", "items"]], ['["list","items"]']),
    ("VARCHAR", "struct<key:string>", [("value",)], ['{"key":"value"}']),
    ("VARCHAR[5]", "string", ["hello world", "abcdé", "abcé", "日本", "😀😀", "a😀b"], ["hello", "abcd", "abcé", "日", "😀", "a😀"]),
    ("VARCHAR[1]", "string", ["é", "日", "😀", "ab", ""], ["", "", "", "a", ""]),
    ("VARCHAR[10]", "string", ["hello"], ["hello"]),
    ("NULL", "string", ["anything", None], [None, None]),
    ("INTERVAL", "double", [1.5, 0.25, -0.5, 2.0, None], [dt.timedelta(days=1.5), dt.timedelta(hours=6), dt.timedelta(hours=-12), dt.timedelta(2), None]),
    ("INTERVAL", "long", [3], [dt.timedelta(3)]),
    ("ARRAY<INTEGER>", "array<long>", [[1, 2, 3], [], None], [[1, 2, 3], [], None]),
    ("ARRAY<INTEGER>", "string", ["[1, 2, 3]", "[1, null, 3]", None], [[1, 2, 3], [1, None, 3], None]),
    ("ARRAY<INTEGER>", "binary", [b"[1, 2, 3]"], [[1, 2, 3]]),
    ("ARRAY<DOUBLE>", "string", ["[1.1, 2.2]"], [[1.1, 2.2]]),
    ("ARRAY<BOOLEAN>", "array<boolean>", [[True, False]], [[True, False]]),
    ("ARRAY<BOOLEAN>", "string", ['["true", "false", "yes"]'], [[True, False, True]]),
    ("ARRAY<VARCHAR>", "array<long>", [[1, 2]], [["1", "2"]]),
    ("ARRAY<BLOB>", "binary", [b'["hello", "world"]'], [[b"hello", b"world"]]),
    ("ARRAY<DATE>", "array<string>", [["2023-04-18", "x"]], [[DAY, None]]),
    ("ARRAY<TIMESTAMP>", "array<string>", [["2023-04-18T12:34:56"]], [[NOON]]),
]


def native(v):
    if isinstance(v, list):
        return [native(x) for x in v]
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_typed_casts(spark, zone):
    """All of them in two jobs by zone; a session's zone changes nothing."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for kind, given, values, want in TYPED:
            df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {given}").coalesce(1)
            got = [native(r.v) for r in df.select("i", P.parse(F.col("v"), kind, df.schema["v"].dataType).alias("v")).collect()]
            assert got == want, (kind, given)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_varchar_of_long_texts_is_quick(spark):
    long = "é" * 20_000
    began = time.time()
    rows = spark.range(2_000).select(P.varchar(F.concat(F.lit(long), F.col("id").cast("string")), 16_000).alias("v")).agg(F.min(F.length("v")), F.max(F.octet_length("v"))).first()
    assert tuple(rows) == (8_000, 16_000) and time.time() - began < 20


def test_row_bytes_keep_types():
    kind = row.Row.make(["a", "b", "c", "d", "e", "f", "g"])
    values = (D("12.340"), dt.time(3, 4, 5, 6), dt.timedelta(days=-1, microseconds=7), NOON, DAY, b"\x00\xff", {"k": [D("1"), None, dt.time(1)]})
    assert tuple(kind.from_bytes(kind(values).to_bytes())) == values


def test_hashes(spark):
    import xxhash

    from tabulon.functions import hashing

    texts = ["", "abc", "é日", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(hashing.hash32_column(F.col("t")).alias("a"), hashing.hash64_column(F.encode("t", "UTF-8")).alias("b")).collect()
    assert [(r.a, None if r.b is None else r.b % 2**64) for r in got] == [(None, None) if t is None else (xxhash.xxh32_intdigest(t.encode()), xxhash.xxh64_intdigest(t.encode())) for t in texts]
    assert hashing.hash64(12) == xxhash.xxh64_intdigest(b"12") and hashing.hash32(b"ab") == xxhash.xxh32_intdigest(b"ab")


def test_validation_of_frames(spark):
    schema = RelationSchema("s", [FlatColumn("a", "INTEGER", nullable=False), FlatColumn("b", "VARCHAR"), FlatColumn("c", "JSONB")])
    df = spark.createDataFrame([(1, 2.0, b"{}"), (None, None, None)], "a long, b double, c binary").coalesce(1)
    assert [r[0] for r in df.select(schema.errors(given=df.schema)).collect()] == [["b: Wrong type, DOUBLE for VARCHAR"], ["a: Column not Nullable"]]
    with pytest.raises(ExcessColumnsInDataError):
        schema.check(df.withColumn("d", F.lit(1)))
    with pytest.raises(Exception, match="c: Column missing"):
        schema.check(df.drop("c")).collect()
    assert schema.check(df.where("a = 1").withColumn("b", F.col("b").cast("string"))).count() == 1


def test_timestamp_text_goes_on_beyond_9999(spark):
    given = ["0", "253402300799", "253402300800", "9223372036854", "9223372036855", "99999999999999999999", "2023-04-18T12:34:56.5Z", "2023-04-18", "x", "", None]
    want = ["1970-01-01 00:00:00", "9999-12-31 23:59:59", "10000-01-01 00:00:00", "294247-01-10 04:00:54", None, None, "2023-04-18 12:34:56", "2023-04-18 00:00:00", None, None, None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string").coalesce(1)
    assert [r.v for r in df.select(P.timestamp_text(F.col("v")).alias("v")).collect()] == want
