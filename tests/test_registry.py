"""Driver contract: entry(), queries(), oracle_sql(); every query against its
DuckDB oracle on the sf0.001 tables (order-insensitive, exact values)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spendlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v) if isinstance(v, float) else str(v)


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)),
                  key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["client_id", "category", "total_spent", "transaction_count",
                          "avg_transaction", "percentage"]


def test_every_query_has_an_oracle():
    own = set(registry.queries())
    assert own == set(registry.oracle_sql()) and own <= set(entry.queries()) and own <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF).toPandas()
    odf = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert _rows(sdf) == _rows(odf)


def test_registered_outputs_have_no_engine_specific_time_types(spark):
    """Timestamps are rendered as text in registered results (see registry)."""
    bad = {}
    for name, q in registry.queries().items():
        types = dict(q(spark, SF).dtypes)
        hits = [c for c, t in types.items() if t.startswith(("timestamp", "date"))]
        if hits:
            bad[name] = hits
    assert bad == {}


@pytest.mark.parametrize("name", ["category_breakdown", "comparison_metrics", "all_kpis",
                                  "loyalty_candidates", "subscriptions", "amount_anomalies",
                                  "optimization_impact", "category_extra_rewards",
                                  "top_merchants", "anomaly_timeline"])
def test_large_client_path_matches_oracle(spark, con, name):
    """Shuffle joins on client_id instead of broadcasts, and a small salt: same
    rows, and no side is replicated below an exchange."""
    from spendlens.plans.joins import SALT_BUCKETS_CONF
    spark.conf.set(SALT_BUCKETS_CONF, "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = registry.QUERIES[name]
        led = registry.get_ledger(spark, SF, q.binding)
        fresh = type(led)(users=led.users, cards=led.cards, transactions=led.transactions,
                          mcc_codes=led.mcc_codes, fraud_labels=led.fraud_labels)
        df = q.build(fresh)
        if q.ts:
            from pyspark.sql import functions as F
            df = df.select(*[F.date_format(c, registry.TS_TEXT_SPARK).alias(c) if c in q.ts
                             else F.col(c) for c in df.columns])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert "_jsalt" not in plan
        sdf = df.toPandas()
    finally:
        spark.conf.unset(SALT_BUCKETS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odf = con.sql(entry.oracle_sql()[name]).df()
    assert _rows(sdf) == _rows(odf)
