from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from spendlens.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
