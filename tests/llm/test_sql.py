"""The operators' queries against their SQL on the smallest data."""

import duckdb
import pandas as pd
import pytest

from colsense.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).select(*want.columns).toPandas()
    text = lambda v: "null" if pd.isna(v) else str(v)
    rows = lambda df: sorted((tuple(map(text, r)) for r in df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
