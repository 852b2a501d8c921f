"""Every query against its SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from timeloom.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        try:
            df[c] = pd.to_numeric(df[c]).astype(float).round(5)
        except (TypeError, ValueError):
            df[c] = df[c].astype(object).where(df[c].notna(), None).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, sql, name):
    got = plain(QUERIES[name](spark, data).toPandas())
    assert len(got)
    if name in ORACLE:
        want = plain(sql.execute(ORACLE[name]).df())
        assert list(got.columns) == list(want.columns) and len(got) == len(want)
        for c in got.columns:
            if got[c].dtype == float:
                assert np.allclose(got[c], want[c].astype(float), equal_nan=True, atol=2e-5), c
            else:
                assert (got[c] == want[c]).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_optional_subpackage():
    """In a process of its own, where it and its pipeline can't be imported."""
    code = "import sys; sys.modules['timeloom.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
