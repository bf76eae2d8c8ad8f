"""Relations, grouping, encodings, interchange and streams."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon import sources
from tabulon.operators import encode as E
from tabulon.operators.frame import Relation, RelationBuilder
from tabulon.operators.position import POSITION, number_rows, read_with_position
from tabulon.schema import DataValidationError, FlatColumn, RelationSchema
from tabulon.streaming import append_to, read_stream, windowed_counts

ROWS = [{"A": 1, "B": "a", "C": 1.0}, {"A": 2, "B": None, "C": 2.0}, {"A": -1, "B": "c", "C": 3.0}, {"A": -2, "B": "c", "C": 4.0}]


@pytest.fixture(scope="module")
def abc(spark):
    return Relation.from_dicts(spark, ROWS)


def test_projection_keeps_names_with_values(abc):
    assert list(abc.select(["C", "A"])) == [(1.0, 1), (2.0, 2), (3.0, -1), (4.0, -2)]
    with pytest.raises(ValueError):
        abc.select("nope")


def test_positions(abc):
    assert abc.row(2) == (-1, "c", 3.0) and abc.row(-1) == (-2, "c", 4.0)
    assert list(abc.tail(9)) == list(abc) and len(abc.head(0)) == 0
    assert [r[0] for r in abc.slice(1)] == [2, -1, -2] and [r[0] for r in abc.slice(-3, 1)] == [2]
    assert [r[0] for r in abc.take([2, 0, 2, 99, -1])] == [1, -1]
    assert [r[0] for r in abc.filter([True, False, True])] == [1, -1]
    assert [len(b) for b in abc.to_batches(3)] == [3, 1] and abc.shape == (4, 3)
    with pytest.raises(IndexError):
        abc.row(50)


def test_query_and_collect(abc):
    assert len(abc.query(lambda r: r.A > 0)) == len(abc.query(F.col("A") > 0)) == len(abc.query("A > 0")) == 2
    assert list(abc.collect("A")) == [1, 2, -1, -2] and abc.collect(["A", 2], 2).shape == (2, 2)
    with pytest.raises(IndexError):
        abc.collect(7)


def test_distinct_compares_values(spark):
    r = Relation.from_rows(spark, [(-1,), (-2,), (-1,)], ["v"])
    assert sorted(r.distinct()) == [(-2,), (-1,)]
    assert [x[0] for x in r.distinct(keep_first=True)] == [-1, -2]


def test_union_needs_equal_schemas(abc):
    assert len(abc + abc) == 8
    with pytest.raises(ValueError):
        abc + abc.select(["A"])


def test_hash_and_cursor(abc, spark):
    again = Relation.from_dicts(spark, ROWS[::-1])
    assert abc.fingerprint().first() == again.fingerprint().first() and abc.nbytes() > 0
    r = Relation.from_dicts(spark, ROWS)
    assert r.fetchone()[0] == 1 and len(r.fetchmany(2)) == 2 and len(r.fetchall()) == 1 and r.fetchone() is None and r.fetchall() == []
    assert r.description[0] == ("A", "INTEGER", None, None, None, None, True)
    assert "[ 4 rows x 3 columns ]" in str(r) and r.markdown().startswith("| A")


def test_group_by(abc, spark):
    g = abc.group_by("B")
    got = {r["B"]: r for r in g.aggregate([("SUM", "A"), ("count", "A"), ("AVG", "C"), ("SUM", "A")]).collect()}
    assert g.sum("A").columns == ["SUM(A)", "B"] and (got["c"]["SUM(A)"], got["c"]["COUNT(A)"], got["c"]["AVG(C)"]) == (-3, 2, 3.5)
    assert {r["B"]: r["COUNT(*)"] for r in g.count().collect()} == {"a": 1, None: 1, "c": 2} and g.groups().count() == 3
    empty = Relation.from_rows(spark, [], RelationSchema("e", [FlatColumn("k"), FlatColumn("v", "INTEGER")]))
    assert empty.group_by("k").sum("v").count() == 0
    with pytest.raises(ValueError):
        g.aggregate([("MEDIAN", "A")])


def test_arrow(spark, abc):
    t = pa.table({"d": pa.array([dt.date(2020, 1, 1)], pa.date32()), "t": pa.array([dt.datetime(2020, 1, 1)], pa.timestamp("us")), "x": pa.array([[1, 2]])})
    r = Relation.from_arrow(spark, [t, t.slice(0, 0), t])
    assert len(r) == 2 and r.arrow().schema.field("d").type == pa.date32() and r.arrow(0).num_rows == 0
    assert list(abc.pandas(2)["A"]) == [1, 2] and len(Relation.from_arrow(spark, None)) == 0
    assert len(sources.from_pandas(spark, abc.pandas())) == 4


def test_builder(spark):
    b = RelationBuilder(spark, RelationSchema("j", [FlatColumn("id", "INTEGER", nullable=False), FlatColumn("payload", "JSONB")]))
    b.append({"id": 1, "payload": {"k": [1]}})
    with pytest.raises(DataValidationError):
        b.append({"id": None, "payload": None})
    assert bytes(b.relation().row(0)[1]) == b'{"k": [1]}' and len(b) == 1


def test_positions_over_files(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    p = [r[0] for r in read_with_position(spark, str(tmp_path / "t")).select(POSITION).collect()]
    assert sorted(p) == list(range(100))
    n = number_rows(spark.range(50).select((50 - F.col("id")).alias("k")), "k")
    assert all(r[POSITION] == r.k - 1 for r in n.collect())


def test_rle_over_blocks(spark):
    values = [1] * 10 + [None] * 3 + [2] + [1] * 25 + [3] * 4
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v int")
    runs = E.rle_encode(df, "pos", "v", block=8)
    assert sorted((r.start_pos, r.run_value, r.run_length) for r in runs.collect()) == [(0, 1, 10), (10, None, 3), (13, 2, 1), (14, 1, 25), (39, 3, 4)]
    assert [r.v for r in E.rle_decode(runs).orderBy("pos").collect()] == values
    assert E.rle_encode(df.limit(0), "pos", "v").count() == 0
    nan = spark.createDataFrame([(0, float("nan")), (1, float("nan"))], "pos long, v double")
    assert E.rle_encode(nan, "pos", "v").count() == 2


def test_dictionary_and_sparse(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "pos long, v string")
    codes = E.dictionary(df, "pos", "v")
    assert {r.v: r.code for r in codes.collect()} == {"b": 0, None: 1, "a": 2}
    back = E.dict_decode(E.dict_encode(df, codes, "v").drop("v"), codes)
    assert sorted((r.pos, r.v or "") for r in back.collect()) == [(0, "b"), (1, ""), (2, "a"), (3, "b")]
    with pytest.raises(Exception, match="outside the dictionary"):
        E.dict_decode(spark.createDataFrame([(0, 9)], "pos long, code long"), codes).collect()
    s = E.sparse_encode(df, "pos", "v", "b")
    assert [r.v for r in E.sparse_decode(s, 4, "b").orderBy("idx").collect()] == ["b", None, "a", "b"]
    calls = []
    assert E.function_column(df, "f", lambda: calls.append(1) or 5).where("f = 5").count() == 4 and calls == [1]


def test_files_and_streams(spark, tmp_path):
    r = Relation.from_rows(spark, [(1, dt.datetime(2020, 1, 1, 0, 5)), (2, dt.datetime(2020, 1, 1, 3))], ["id", "at"])
    for kind in ("parquet", "csv", "jsonl", "orc"):
        sources.write(r, str(tmp_path / kind), kind)
        assert len(sources.read(spark, str(tmp_path / kind), kind, r.spark.schema)) == 2
    stream = read_stream(spark, str(tmp_path / "parquet"), r.spark.schema)
    append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = windowed_counts(stream, "at", "id").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").count() == 2


def test_the_library_does_without_llm():
    import pathlib
    import re

    import tabulon

    for p in pathlib.Path(tabulon.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\s+[\w.]*\bllm\b", p.read_text()), p


def test_places_of_derived_relations(spark):
    r = Relation.from_rows(spark, [(i, "ab"[i % 2]) for i in range(10)], ["a", "b"])
    late = r.query("a >= 5")
    values = lambda x: x.collect("a").tolist()
    assert values(late.take([0, 1])) == [5, 6] and values(late.filter([True, False, True])) == [5, 7]
    assert [x.batch_id for x in late.batch_ids(2).orderBy("a").collect()] == [0, 0, 1, 1, 2]
    assert [values(b) for b in late.to_batches(2)] == [[5, 6], [7, 8], [9]]
    both = late + r.query("a < 2")
    assert values(both) == [5, 6, 7, 8, 9, 0, 1] and values(both.head(6)) == [5, 6, 7, 8, 9, 0] and values(both.take([4, 5])) == [9, 0]
    assert values(both.slice(3, 3)) == [8, 9, 0] and values(both.slice(-2)) == [0, 1] and both.row(-1) == (1, "b") and late.row(1) == (6, "a")
    assert [x.a for x in r.tail(3).spark.collect()] == [7, 8, 9] and [x.a for x in r.slice(-4, 2).spark.collect()] == [6, 7]
    assert (r + late).select("b").distinct().collect("b").tolist() == ["a", "b"] and values(r.slice(8).slice(1)) == [9] and values(r.slice(20)) == []
    for bad in (10, -11, -100):
        with pytest.raises(IndexError):
            r.row(bad)


def test_encode_dispatch(spark):
    df = spark.createDataFrame([(0, "x", {"k": 1}), (1, "x", None), (2, None, None)], "p long, v string, m map<string,int>")
    assert {(r.start_pos, r.run_value, r.run_length) for r in E.encode(df, "rle", "p", "v").collect()} == {(0, "x", 2), (2, None, 1)}
    codes = E.dictionary(df, "p", "v")
    assert sorted((r.p, r.v) for r in E.decode(E.encode(df, "dictionary", "p", "v"), "dictionary", codes).where("v is not null").collect()) == [(0, "x"), (1, "x")]
    assert E.decode(E.encode(df, "sparse", "p", "v"), "sparse", length=3).count() == 3
    for kind, column in (("rle", "m"), ("dictionary", "m"), ("sparse", "m"), ("other", "v")):
        with pytest.raises(TypeError):
            E.encode(df, kind, "p", column)
    with pytest.raises(TypeError):
        E.decode(df, "dictionary")


def test_builder_counts_bytes(spark):
    b = RelationBuilder(spark, ["a", "b"])
    sizes = []
    for i in range(5):
        b.append({"a": i, "b": "x" * i})
        sizes.append(b.nbytes)
    assert sizes[0] > 0 and all(y > x for x, y in zip(sizes, sizes[1:])) and b.relation().rowcount == 5


def test_numbers_of_many_rows(spark, monkeypatch):
    """Places stay gapless where range bounds are sampled and where rows fill many blocks."""
    from tabulon.operators import position

    n = 400_000
    df = spark.range(0, n, 1, 16).withColumn("v", F.xxhash64("id")).repartition(16, "v")
    numbered = number_rows(df, "v").select("v", POSITION)
    one = numbered.agg(F.count("*"), F.countDistinct(POSITION), F.min(POSITION), F.max(POSITION)).first()
    assert tuple(one) == (n, n, 0, n - 1)
    ordered = [r.v for r in numbered.where(F.col(POSITION).isin([0, 1, 200_000, n - 1])).orderBy(POSITION).collect()]
    assert ordered == sorted(ordered) and ordered[0] == df.agg(F.min("v")).first()[0] and ordered[-1] == df.agg(F.max("v")).first()[0]
    monkeypatch.setattr(position, "BLOCK", 1_000)
    some = Relation(spark.range(0, n, 1, 16).withColumn(POSITION, F.col("id") * 7)).query("id % 3 = 1").dense()
    wrong = some.held.where(F.col("id") != F.col(POSITION) * 3 + 1).count()
    assert some.rowcount == n // 3 and wrong == 0
