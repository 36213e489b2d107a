"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float",
          "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def _duck_type(t):
    t = str(t)
    return t.lower().replace(" ", "") if t.startswith("DECIMAL") else _TYPES.get(t, t)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        df = E.queries()[name](spark, SF)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        assert {d[0]: _duck_type(d[1]) for d in res.description} == spark_types
        assert _canon(df.columns, rows) == _canon(cols, res.fetchall())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")


def test_every_query_has_oracle_or_is_listed():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "fie" and df.count() > 0
