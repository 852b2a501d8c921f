"""The queries that SQL can express, against it."""

import duckdb
import pytest

from timeloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, d).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(tuple, df.astype(object).where(df.notna(), "").itertuples(index=False)), key=str)
    assert len(got) and rows(got) == rows(want)
