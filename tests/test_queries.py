import math

import duckdb
import pytest

from plumbline.plans import cohorts, models, splits, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Need more rows than the smallest size has.
LARGER = {"p5_draws", "a17_drawn_positions", "w2_stratified", "p4_capped"}
PLAIN = {n: q for m in (text, splits, cohorts, models) for n, q in m.QUERIES.items() if n not in m.SQL}
SQL = {n: (m.QUERIES[n], q) for m in (text, splits, cohorts, models) for n, q in m.SQL.items()}


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    cons = {}

    def at(sf):
        if sf not in cons:
            cons[sf] = duckdb.connect()
            for t in TABLES:
                cons[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return cons[sf]

    return at


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    query, sql = SQL[name]
    sf = SF.replace("0.001", "0.01") if name in LARGER else SF
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck(sf).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_without_sql_gives_rows(spark, name):
    df = PLAIN[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)
