"""Each query with SQL gives the rows that DuckDB gives for it on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from framelake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = canonical(got.fetchall(), names)
        assert canonical(rows, df.columns) == want
        assert want, "an empty result shows nothing"
