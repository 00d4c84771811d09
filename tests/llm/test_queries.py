"""Every query of this subpackage that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from textloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
