"""Queries over the driver's tables, each through one operator of the library."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import display as show
from .. import faker, row, sources
from ..functions import parse as P
from ..operators import encode as E
from ..operators.frame import Relation, RelationBuilder
from ..operators.position import POSITION
from ..schema import DataValidationError, ExcessColumnsInDataError, FlatColumn, RelationSchema, statistics
from ..types import NAMES, parse_type, promote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Rel = Callable[[str], Relation]


def query(f: Callable[[Rel, SparkSession], DataFrame]):
    """Registers a query of a table reader."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: Relation.from_parquet(spark, f"{sf_dir}/{name}.parquet"), spark)

    QUERIES[f.__name__] = run
    return f


def column(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query of one plain table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark.read.parquet(f"{sf_dir}/{name.split(':')[1]}.parquet"))

    QUERIES[name.split(":")[0]] = run


@query
def scan(t: Rel, spark: SparkSession) -> DataFrame:
    return t("nation").spark


@query
def select_reorder(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").select(["o_totalprice", "o_orderkey"]).spark


@query
def query_predicate(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").query("o_totalprice > 200000 AND o_orderstatus = 'F'").spark


@query
def filter_mask(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").filter(F.col("event_id") % 3 == 0).spark


@query
def filter_short_mask(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").filter([i % 2 == 0 for i in range(100)]).spark


@query
def take(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").take([4, 0, 2, 97, 2, -1]).spark


@query
def head(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").head(5).spark


@query
def tail(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").tail(5).spark


@query
def slice(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").slice(100, 20).spark


@query
def slice_negative(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").slice(-10, 3).spark


@query
def row_at(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events")
    return spark.createDataFrame([events.row(7), events.row(-1)], events.spark.schema)


@query
def collect_limit(t: Rel, spark: SparkSession) -> DataFrame:
    keys, prices = t("orders").collect(["o_orderkey", "o_totalprice"], limit=10)
    return spark.createDataFrame([(int(k), float(p)) for k, p in zip(keys, prices)], "o_orderkey long, o_totalprice double")


@query
def distinct(t: Rel, spark: SparkSession) -> DataFrame:
    return t("lineitem").select(["l_returnflag", "l_linestatus"]).distinct().spark


@query
def distinct_with_nulls(t: Rel, spark: SparkSession) -> DataFrame:
    return Relation(t("events").spark.select(F.nullif("event_type", F.lit("view")).alias("event_type"))).distinct().spark


@query
def union_all(t: Rel, spark: SparkSession) -> DataFrame:
    return (t("nation") + t("nation")).spark


@query
def union_distinct_rows(t: Rel, spark: SparkSession) -> DataFrame:
    return (t("nation") + t("nation")).distinct().spark


@query
def shape(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([t("orders").shape], "rowcount long, columncount long")


@query
def batches(t: Rel, spark: SparkSession) -> DataFrame:
    ids = t("events").batch_ids(1_000)
    return ids.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def group_count(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").group_by("o_orderstatus").count()


@query
def group_count_column(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events").spark.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return Relation(events).group_by("user_id").aggregate([("COUNT", "event_type")])


@query
def group_sum(t: Rel, spark: SparkSession) -> DataFrame:
    return t("lineitem").group_by("l_returnflag").sum("l_linenumber")


@query
def group_min(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").group_by(["o_orderpriority"]).min("o_totalprice")


@query
def group_max(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").group_by("o_custkey").max("o_orderdate")


@query
def group_avg(t: Rel, spark: SparkSession) -> DataFrame:
    return t("lineitem").group_by("l_returnflag").avg("l_quantity").withColumn("AVG(l_quantity)", F.round(F.col("`AVG(l_quantity)`"), 6))


@query
def group_multi(t: Rel, spark: SparkSession) -> DataFrame:
    items = t("lineitem").spark.withColumn("q", F.col("l_quantity").cast("decimal(12,2)"))
    out = Relation(items).group_by(["l_returnflag", "l_linestatus"]).aggregate([("SUM", "q"), ("COUNT", "l_quantity"), ("MIN", "l_quantity"), ("MAX", "l_quantity")])
    return out.withColumn("SUM(q)", F.col("`SUM(q)`").cast("decimal(18,2)")).withColumnRenamed("SUM(q)", "SUM(l_quantity)")


@query
def group_all_null(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events").spark.withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return Relation(events).group_by("event_type").aggregate([("MIN", "value"), ("COUNT", "*")])


@query
def groups(t: Rel, spark: SparkSession) -> DataFrame:
    return t("orders").group_by(["o_orderstatus", "o_orderpriority"]).groups()


@query
def column_stats(t: Rel, spark: SparkSession) -> DataFrame:
    found = statistics(t("orders").spark, ["o_totalprice"])
    return found.select(F.col("lowest_value").cast("double").alias("lowest_value"), F.col("highest_value").cast("double").alias("highest_value"), "null_count")


@query
def validate(t: Rel, spark: SparkSession) -> DataFrame:
    orders = t("orders").spark.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    faults = RelationSchema("orders", [FlatColumn("o_orderkey", "INTEGER"), FlatColumn("o_orderstatus", "VARCHAR", nullable=False)]).errors()
    return orders.select("o_orderkey", F.regexp_replace(F.get(faults, 0), "^o_orderstatus: ", "").alias("error"))


column("cast_boolean:events", lambda d: d.select("event_id", P.boolean(F.element_at(F.array(*map(F.lit, ("on", "off", "1.0", "y", "abc"))), (F.col("event_id") % 5 + 1).cast("int")), T.StringType()).alias("flag")))
column("cast_integer:events", lambda d: d.select("event_id", P.integer(F.col("value"), T.DoubleType()).alias("value_int")))
column("cast_decimal:events", lambda d: d.select("event_id", P.decimal(F.col("value"), 12, 2).alias("value_dec")))
column("cast_varchar_n:customer", lambda d: d.select("c_custkey", P.varchar(F.col("c_name"), 8).alias("c_name8")))
column("cast_blob_n:customer", lambda d: d.select("c_custkey", P.blob(F.col("c_name"), 5).alias("c_name_blob")))
column("cast_date:events", lambda d: d.select("event_id", P.date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), T.StringType()).alias("d")))
column("cast_timestamp_iso:events", lambda d: d.select("event_id", P.timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), T.StringType()).alias("ts_s")))
column("cast_timestamp_epoch:events", lambda d: d.select("event_id", P.timestamp((F.col("event_id") * 1000).cast("string"), T.StringType()).alias("ts_e")))
column("cast_interval:events", lambda d: d.select("event_id", (F.col("ts") + P.interval(F.col("event_id") % 5)).alias("ts_shift")))
column("cast_array:events", lambda d: d.select("event_id", P.parse(F.format_string("[%d, %d]", F.col("event_id"), F.col("event_id") + 1), "ARRAY<INTEGER>", T.StringType()).alias("arr")))
column("cast_vector:embeddings", lambda d: d.select("vec_id", P.vector(F.col("embedding"), d.schema["embedding"].dataType).alias("v")))
column("json_field:events", lambda d: d.select("event_id", P.json_field(F.col("props"), "k", "INTEGER").alias("k")))
column("redact:customer", lambda d: d.select("c_custkey", P.redacted(F.col("c_name")).alias("redacted")))
column("row_json:nation", lambda d: d.select("n_nationkey", row.json_column().alias("js")))
column("constant_column:events", lambda d: E.constant(d.select("event_id"), "c", "fixed"))
column("sparse_encode:events", lambda d: E.sparse_encode(d, "event_id", "event_type", "view"))
column("rle_encode:events", lambda d: E.rle_encode(d, "event_id", "event_type"))
column("rle_decode:events", lambda d: E.rle_decode(E.rle_encode(d, "event_id", "event_type")))
column("dict_encode:events", lambda d: E.dictionary(d, "event_id", "event_type"))
column("dict_encode_sorted:events", lambda d: E.dict_encode(d.select("event_id", "event_type"), E.dictionary_sorted(d, "event_type"), "event_type").select("event_id", "code"))


@query
def dict_decode(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events").spark.select("event_id", "event_type")
    codes = E.dictionary(events, "event_id", "event_type")
    return E.dict_decode(E.dict_encode(events, codes, "event_type").drop("event_type"), codes)


@query
def sparse_decode(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events")
    return E.sparse_decode(E.sparse_encode(events.spark, "event_id", "event_type", "view"), events.rowcount, "view")


@query
def compressed_multiply(t: Rel, spark: SparkSession) -> DataFrame:
    items = t("lineitem").spark.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("doubled"))
    codes = E.dictionary_sorted(items, "doubled")
    encoded = E.dict_encode(items, codes, "doubled").drop("doubled")
    return E.dict_decode(encoded, E.on_values(codes, "doubled", lambda v: v * 2))


@query
def frame_hash(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").select(["event_id", "event_type"]).fingerprint()


@query
def arrow_roundtrip(t: Rel, spark: SparkSession) -> DataFrame:
    return Relation.from_arrow(spark, t("customer").arrow()).spark


@query
def description(t: Rel, spark: SparkSession) -> DataFrame:
    rows = [(d[0], d[1], d[6]) for d in t("nation").description]
    return spark.createDataFrame(rows, "name string, type_code string, null_ok boolean")


@query
def flagship(t: Rel, spark: SparkSession) -> DataFrame:
    items = t("lineitem").query("l_quantity > 10").spark
    exact = items.select("l_returnflag", "l_linestatus", "l_discount", F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("l_extendedprice"))
    out = Relation(exact).group_by(["l_returnflag", "l_linestatus"]).aggregate([("SUM", "l_quantity"), ("SUM", "l_extendedprice"), ("AVG", "l_discount"), ("COUNT", "*")])
    return out.withColumns({"SUM(l_quantity)": F.col("`SUM(l_quantity)`").cast("decimal(18,2)"), "SUM(l_extendedprice)": F.col("`SUM(l_extendedprice)`").cast("decimal(20,2)"), "AVG(l_discount)": F.round(F.col("`AVG(l_discount)`"), 6)})


@query
def row_bytes(t: Rel, spark: SparkSession) -> DataFrame:
    return row.frames(t("nation").spark)


@query
def fake_data(t: Rel, spark: SparkSession) -> DataFrame:
    kinds = ("INTEGER", "VARCHAR", "BOOLEAN", "DECIMAL", "DOUBLE", "TIMESTAMP")
    return faker.generate_fake_data(spark, RelationSchema("made", [FlatColumn(k.lower(), k) for k in kinds]), 10_000, seed=42)


@query
def display(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t("nation").display(),), (t("nation").markdown(),)], "shown string")


@query
def promotion_table(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, promote([a, b]).name) for a in NAMES for b in NAMES], "a string, b string, result string")


@query
def distinct_keep_first(t: Rel, spark: SparkSession) -> DataFrame:
    first = t("events").select(["event_type"]).distinct(keep_first=True).held
    return first.select("event_type", F.col(POSITION).alias("first_position"))


# derived relations: places count their own rows
@query
def take_after_query(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").query("event_id % 7 = 3").take([0, 2, 5, 1_000_000]).spark


@query
def mask_after_query(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").query("event_id % 7 = 3").filter([i % 3 == 0 for i in range(90)]).spark


@query
def batches_after_query(t: Rel, spark: SparkSession) -> DataFrame:
    ids = t("events").query("event_type != 'view'").batch_ids(500)
    return ids.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query
def slice_after_query(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").query("event_type != 'view'").slice(40, 30).spark


@query
def slice_of_slice(t: Rel, spark: SparkSession) -> DataFrame:
    return t("events").slice(-100).slice(10, 20).take([0, 19]).spark


@query
def batch_three(t: Rel, spark: SparkSession) -> DataFrame:
    found = list(t("nation").to_batches(7))
    return found[3].spark


@query
def head_of_union(t: Rel, spark: SparkSession) -> DataFrame:
    return (t("region") + t("region").query("r_regionkey > 2")).head(7).spark


@query
def take_of_union(t: Rel, spark: SparkSession) -> DataFrame:
    nation = t("nation")
    return (nation.query("n_regionkey = 1") + nation.query("n_regionkey = 3")).take([0, 4, 5, 9]).spark


@query
def distinct_in_order(t: Rel, spark: SparkSession) -> DataFrame:
    first = t("orders").select(["o_orderpriority"]).distinct().dense().held
    return first.select("o_orderpriority", F.col(POSITION).alias("place"))


@query
def from_dicts(t: Rel, spark: SparkSession) -> DataFrame:
    return Relation.from_dicts(spark, [{"a": 1, "b": "x"}, {"b": "y", "c": 3}, {"a": 4}]).spark


@query
def append_records(t: Rel, spark: SparkSession) -> DataFrame:
    schema = RelationSchema("made", [FlatColumn("id", "INTEGER", nullable=False), FlatColumn("name", "VARCHAR"), FlatColumn("price", "DECIMAL(10,2)")])
    builder = RelationBuilder(spark, schema)
    for k in t("nation").select("n_nationkey").collect("n_nationkey"):
        builder.append({"id": int(k), "name": None if k % 5 == 0 else f"nation {k}", "price": Decimal(int(k)) / 4})
    return builder.relation().spark


@query
def defaults(t: Rel, spark: SparkSession) -> DataFrame:
    events = t("events").spark.select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    return RelationSchema("events", [FlatColumn("event_id", "INTEGER"), FlatColumn("event_type", "VARCHAR", default="none"), FlatColumn("value", "DOUBLE", default=-1.0)]).with_defaults(events)


@query
def validate_types(t: Rel, spark: SparkSession) -> DataFrame:
    orders = t("orders").spark.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"), F.lit(1).alias("extra"))
    schema = RelationSchema("orders", [FlatColumn("o_orderkey", "INTEGER"), FlatColumn("o_orderstatus", "VARCHAR", nullable=False), FlatColumn("price", "INTEGER"), FlatColumn("lost", "DATE")])
    return orders.select("o_orderkey", F.array_join(schema.errors(given=orders.schema), "; ").alias("faults"))


# parsers at their edges
_WIDE = ("123456789012.5", "12345678901234567", "0.1234567890123456789012", "-99999999999999999.999999999999999999999", "2.5", "abc", "1e3", "99999999999999999999999999999999999999")
column("cast_decimal_wide:events", lambda d: d.select("event_id", P.decimal(F.element_at(F.array(*map(F.lit, _WIDE)), (F.col("event_id") % len(_WIDE) + 1).cast("int")), 38, 21, T.StringType()).cast("string").alias("dec")))
column("cast_decimal_big:events", lambda d: d.select("event_id", P.decimal(F.concat(F.col("event_id").cast("string"), F.lit("0000000000000000000000.125")), 38, 2, T.StringType()).cast("string").alias("dec")))
column("cast_double:events", lambda d: d.select("event_id", P.double(F.element_at(F.array(*map(F.lit, ("1.5", "-2e3", "x", "", "7"))), (F.col("event_id") % 5 + 1).cast("int")), T.StringType()).alias("num")))
column("cast_time:events", lambda d: d.select("event_id", P.time_of_day(F.col("ts"), d.schema["ts"].dataType).alias("t")))
column("cast_varchar_bytes:events", lambda d: d.select("event_id", P.varchar(F.concat(F.col("event_id").cast("string"), F.lit("é日😀xyz")), 9).alias("short")))
column("cast_interval_fraction:events", lambda d: d.select("event_id", (F.col("ts").cast("timestamp_ntz") + P.interval(F.col("event_id") % 8 / 4)).alias("ts_shift")))
column("encode_rle:events", lambda d: E.encode(d, "rle", "event_id", "event_type"))
column("encode_dictionary:events", lambda d: E.encode(d, "dictionary", "event_id", "event_type"))


def cast_epoch_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds read the same in whatever zone: the plan is analysed in another one, which its expressions keep when it runs, as text."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", P.timestamp_text((F.col("event_id") * 86_399).cast("string")).alias("moment"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


QUERIES["cast_epoch_zone"] = cast_epoch_zone


# construction and interchange
@query
def from_tuples(t: Rel, spark: SparkSession) -> DataFrame:
    rows = [tuple(r) for r in t("region").select(["r_regionkey", "r_name"])]
    return Relation.from_rows(spark, rows, ["key", "name"]).spark


@query
def pandas_roundtrip(t: Rel, spark: SparkSession) -> DataFrame:
    return sources.from_pandas(spark, t("supplier").pandas()).spark


@query
def column_arrays(t: Rel, spark: SparkSession) -> DataFrame:
    nation = t("nation")
    return spark.createDataFrame(list(zip(nation["n_name"].tolist(), nation[0].tolist())), "name string, key long")


@query
def record_columns(t: Rel, spark: SparkSession) -> DataFrame:
    records = [r.as_dict for r in map(_rows_of(t("nation")), t("nation"))]
    names, keys = row.extract_columns(records, ["n_name", "n_regionkey"])
    return spark.createDataFrame([(*row.extract_fields(r, ["n_nationkey", "none"]), n, k) for r, n, k in zip(records, names, keys)], "nation long, nothing string, name string, region long")


def _rows_of(r: Relation) -> type[row.Row]:
    return row.Row.make(list(r.column_names))


@query
def row_frames_roundtrip(t: Rel, spark: SparkSession) -> DataFrame:
    kind = _rows_of(t("supplier"))
    return spark.createDataFrame([tuple(kind.from_bytes(kind(r).to_bytes())) for r in t("supplier")], t("supplier").spark.schema)


@query
def row_accessors(t: Rel, spark: SparkSession) -> DataFrame:
    rows = list(map(_rows_of(t("region")), t("region")))
    return spark.createDataFrame([(r.get("r_name"), r.get("none", "-"), ",".join(r.keys()), r.as_map[0][1], r.as_json) for r in rows], "name string, other string, fields string, key long, js string")


@query
def frame_bytes(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t("nation").nbytes(),)], "bytes long")


@query
def cursor_fetches(t: Rel, spark: SparkSession) -> DataFrame:
    nation = t("nation").select(["n_nationkey", "n_name"])
    got = [("one", nation.fetchone()), *(("many", r) for r in nation.fetchmany(4)), *(("all", r) for r in nation.fetchall())]
    return spark.createDataFrame([(how, *r) for how, r in got] + [("end", -1, str(nation.fetchone()))], "how string, key long, name string")


@query
def materialized(t: Rel, spark: SparkSession) -> DataFrame:
    held = t("customer").materialize()
    return spark.createDataFrame([(len(held), held.columncount, sum(1 for _ in held))], "rowcount long, columncount long, iterated long")


@query
def query_callable(t: Rel, spark: SparkSession) -> DataFrame:
    return t("nation").query(lambda r: r.n_regionkey == 2 and "I" in r.n_name).spark


@query
def cast_null(t: Rel, spark: SparkSession) -> DataFrame:
    return t("region").spark.select("r_regionkey", P.parse(F.col("r_name"), "NULL").cast("string").alias("nothing"))


@query
def function_column(t: Rel, spark: SparkSession) -> DataFrame:
    return E.function_column(t("region").spark.select("r_regionkey"), "made", lambda a, b: a * b, 6, 7)


# types and schemas
@query
def type_names(t: Rel, spark: SparkSession) -> DataFrame:
    texts = ["bigint", "VARCHAR[12]", "decimal(10, 2)", "list", "array<date>", "vector[8]", "numeric(4,1)", "bson", "blob[3]", "Timestamp", "varchar[x]", "decimal(40,2)", "array<array<integer>>", "integer[3]", ""]

    def read(text: str) -> tuple:
        try:
            k = parse_type(text)
        except ValueError:
            return text, None, None, None, None, None
        return text, str(k), k.is_numeric, k.is_temporal, k.is_complex, k.python_type.__name__

    return spark.createDataFrame([read(x) for x in texts], "given string, type string, numeric boolean, temporal boolean, complex boolean, python string")


@query
def arrow_fields(t: Rel, spark: SparkSession) -> DataFrame:
    there = RelationSchema.from_arrow(t("orders").arrow(1).schema)
    back = there.arrow()
    return spark.createDataFrame([(c.name, str(c.type), str(f.type), c.nullable, str(FlatColumn.from_arrow(f).type)) for c, f in zip(there, back)], "name string, type string, arrow string, nullable boolean, again string")


_MADE = RelationSchema("made", [FlatColumn("id", "INTEGER", aliases=("key", "nr"), nullable=False), FlatColumn("name", "VARCHAR[8]", default="x"), FlatColumn("price", "DECIMAL(9,2)", disposition="MONEY")], aliases=["m"])


@query
def schema_lookup(t: Rel, spark: SparkSession) -> DataFrame:
    wanted = ["id", "nr", "NAME", "price", "none"]
    name = lambda c: c and c.name
    return spark.createDataFrame([(w, name(_MADE.find_column(w)), name(_MADE.find_column(w, case_insensitive=True))) for w in wanted], "wanted string, found string, found_in_any_case string")


@query
def schema_algebra(t: Rel, spark: SparkSession) -> DataFrame:
    both = _MADE + RelationSchema("other", [_MADE.columns[1], FlatColumn("late", "DATE")], aliases=["o", "m"])
    gone = both.pop_column("key")
    return spark.createDataFrame([(i, c.name, ",".join(c.all_names), gone.name, ",".join(both.aliases), both.num_columns) for i, c in enumerate(both)], "place long, name string, names string, gone string, aliases string, columns long")


@query
def schema_roundtrip(t: Rel, spark: SparkSession) -> DataFrame:
    import json

    back = RelationSchema.from_dict(json.loads(_MADE.to_json()))
    again = RelationSchema.from_spark(back.spark)
    return spark.createDataFrame([(c.name, str(c.type), c.nullable, c.default, FlatColumn.from_json(c.to_json()).disposition, c.to_flatcolumn().disposition, str(again.column(i).type), again.column(c.name) is not None) for i, c in enumerate(back)], "name string, type string, nullable boolean, preset string, disposition string, flat string, again string, found boolean")


@query
def record_faults(t: Rel, spark: SparkSession) -> DataFrame:
    records = [{"id": 1, "name": "a", "price": None}, {"id": None, "name": 3, "price": None}, {"id": 1}, {"id": 1, "name": "a", "price": None, "more": 1, "most": 2}]

    def fault(r: dict) -> str:
        try:
            _MADE.validate(r)
        except (DataValidationError, ExcessColumnsInDataError) as e:
            return str(e)
        return "valid"

    return spark.createDataFrame([(i, fault(r)) for i, r in enumerate(records)], "record long, fault string")


# display
@query
def markdown_lines(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(t("region").select(["r_regionkey", "r_name"]).markdown(limit=3).split("\n"))), "line long, shown string")


@query
def html_table(t: Rel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t("region").select(["r_regionkey", "r_name"])._repr_html_(),)], "shown string")


@query
def display_footer(t: Rel, spark: SparkSession) -> DataFrame:
    lines = t("nation").select(["n_nationkey", "n_name"]).display(limit=2, display_width=False, show_types=True).split("\n")
    return spark.createDataFrame([(i, x.strip("│ ").replace("│", "|")) for i, x in enumerate(lines) if "│" in x or x.startswith("[")], "line long, shown string")


@query
def interval_text(t: Rel, spark: SparkSession) -> DataFrame:
    from datetime import timedelta

    return spark.createDataFrame([(s, show.span(timedelta(seconds=s))) for s in (0, 59, 3_600, 90_061, 31_536_000)], "seconds long, shown string")
