"""Every query of the catalogue against DuckDB on the same files."""

import os

import duckdb
import pytest

from tabulon.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
    else:
        assert rows


def test_aggregation_is_partial_and_pruned(spark):
    plan = QUERIES["flagship"](spark, SF)._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "l_comment" not in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan


def test_epoch_zone_reads_in_place(spark, tmp_path):
    """No row goes through the driver, expressions keep the other zone, and moments go on beyond the year 9999, as in its SQL."""
    ids = [0, 1, 99_999, 2_932_920, 2_932_936, 5_999_999, 99_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["cast_epoch_zone"](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert df.inputFiles() and "America/New_York" in df._jdf.queryExecution().analyzed().toJSON()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLES["cast_epoch_zone"]).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and max(len(m) for _, m in want) > 19
