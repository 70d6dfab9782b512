"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def normal(rows, columns):
    def cell(v):
        return "~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op")])
def test_query_is_its_sql(spark, duck, name):
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    rel = duck.sql(ORACLES[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(rel.columns)
    if got:
        assert sorted(got[0]) == columns
    assert normal(got, columns) == normal(want, columns)
