"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pytest

from lodestone.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(found, names):
    order = sorted(names)
    return sorted((tuple(norm(r[names.index(c)]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.fetchall(), rel.columns)
