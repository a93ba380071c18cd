"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _cells(rows):
    return sorted(tuple("null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _cells(df.select(*columns).collect())
    if name in ORACLE:
        names = ", ".join(f'"{c}"' for c in columns)
        assert got == _cells(duck.execute(f"SELECT {names} FROM ({ORACLE[name]})").fetchall())
    else:
        assert got
