"""Every query of the catalogue against its SQL, run by DuckDB on the smallest tables."""

import duckdb
import pytest

from bagloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return repr(float(v) + 0.0) if isinstance(v, int | float) else str(v)


def _table(rows, cols):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = _table([tuple(r) for r in df.collect()], df.columns)
    want = oracle.execute(ORACLE_SQL[name])
    assert got == _table(want.fetchall(), [c[0] for c in want.description])
