"""Registered corpus queries against their SQL."""

from pathlib import Path

import duckdb
import pytest
from segflow.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def normal(row):
    return tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(normal(r) for r in df.select(*columns).collect())
    assert got == sorted(normal(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
