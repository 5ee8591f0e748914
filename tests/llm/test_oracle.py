"""Queries with SQL give the rows that DuckDB gives for them on the smallest tables."""

import duckdb
import pytest

from framelake.llm.registry import ORACLE_SQL, QUERIES
from tests.test_oracle import SF, canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(got.fetchall(), names)
