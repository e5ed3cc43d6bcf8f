"""The stored ledger: loads, months pruned at run time, one scan, no exchange of ids."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import make_ledger, ts
from spendlens.functions.periods import recent, since
from spendlens.operators import kpis, spending
from spendlens.operators.merchants import merchant_stats
from spendlens.operators.rewards import Rewards
from spendlens.plans.joins import may_match
from spendlens.sources import loaders, store
from spendlens.sources.bindings import ledger as bind

SF = "/root/testdata/sf0.001"

OPERATORS = {
    "category_breakdown": lambda led: spending.category_breakdown(led, "3_months"),
    "monthly_spending": lambda led: kpis.monthly_spending(led, 1),
    "annual_spending": lambda led: Rewards.of(led, "1_year").annual_spending(),
    "comparison_metrics": lambda led: spending.comparison_metrics(led, "3_months"),
    "monthly_trend": lambda led: kpis.monthly_trend(led, 6),
    "all_kpis": kpis.all_kpis,
    "fraud_risk": kpis.fraud_risk,
    "merchant_stats": lambda led: merchant_stats(led, "3_months"),
    "custom_range": lambda led: spending.category_breakdown(led, start="1995-03-01", end="1996-02-01"),
    "patterns": lambda led: spending.spending_patterns(led, "6_months"),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Nation ledger, stored as one load and two later ones."""
    led = bind(spark, SF, "N")
    path = str(tmp_path_factory.mktemp("store"))
    tx, cut = led.transactions, F.lit("1996-06-01").cast("timestamp_ntz")
    led.transactions = tx.where(F.col("date") < cut)
    store.save_ledger(led, path)
    later = tx.where(F.col("date") >= cut)
    assert store.append_transactions(spark, path, later.where("client_id % 3 = 0")) == 2
    assert store.append_transactions(spark, path, later.where("client_id % 3 <> 0")) == 3
    return path


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_same_results_as_the_plain_ledger(spark, stored, name):
    plain, kept = bind(spark, SF, "N"), loaders.load_ledger(spark, stored, fmt="stored")
    assert rows(OPERATORS[name](kept)) == rows(OPERATORS[name](plain)) != []


def test_activity_follows_the_loads(spark, stored):
    kept = loaders.load_ledger(spark, stored, fmt="stored")
    assert rows(kept.activity) == rows(store.activity_of(bind(spark, SF, "N").transactions))


def executed(df):
    """Final plan and metrics of the scans, after a run."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", ["category_breakdown", "monthly_spending", "annual_spending", "comparison_metrics"])
def test_one_scan_of_pruned_months(spark, stored, name):
    kept = loaders.load_ledger(spark, stored, fmt="stored")
    plan = executed(OPERATORS[name](kept)).split("+- == Initial Plan ==")[0]
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "tx_month" in x]
    assert scans and all(re.search(r"PartitionFilters: \[.*tx_month#\d+ >= .*ubquery", s) for s in scans), plan
    # One read of the transactions: the activity table gives the anchors.
    logical = OPERATORS[name](kept)._jdf.queryExecution().optimizedPlan().toString()
    assert len(scans) == 1 == len([x for x in logical.splitlines() if "Relation" in x and "tx_month" in x])
    assert not [x for x in plan.splitlines() if "FileScan" in x and "transactions" in x and "tx_month" not in x]


def test_months_before_every_window_are_not_read(spark, tmp_path):
    led = make_ledger(spark, [(i, 1 + i % 2, 10.0, ts(days=30 * i)) for i in range(40)])
    store.save_ledger(led, str(tmp_path))
    kept = loaders.load_ledger(spark, str(tmp_path), fmt="stored")
    assert recent(kept, 90).count() == len([i for i in range(40) if 30 * i <= 90 + 30 * (i % 2)])
    read = since(kept, 90).select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len({re.search(r"tx_month=(\d+)", r.f)[1] for r in read}) <= 5
    all_months = kept.transactions.select("tx_month").distinct().count()
    assert all_months > 30


def test_a_broken_load_is_not_read_and_can_be_repeated(spark, tmp_path):
    led = make_ledger(spark, [(1, 1, 10.0, ts()), (2, 2, 5.0, ts(1))], labels=[(1, True), (1, True), (9, False)])
    path = str(tmp_path)
    store.save_ledger(led, path)
    more = make_ledger(spark, [(3, 1, 7.0, ts(-1))]).transactions
    # A load that ended before its activity was written.
    more.withColumn("tx_month", store.month_number()).write.partitionBy("tx_month").parquet(f"{path}/transactions/load=2")
    assert loaders.load_ledger(spark, path, fmt="stored").transactions.count() == 2
    assert store.append_transactions(spark, path, more) == 2
    kept = loaders.load_ledger(spark, path, fmt="stored")
    assert sorted(r.id for r in kept.transactions.collect()) == [1, 2, 3]
    assert {r.client_id: r.n_transactions for r in kept.activity.collect()} == {1: 2, 2: 1}
    assert [tuple(r) for r in loaders.labelled_ids(kept).collect()] == [(1, 2, 2)]
    with pytest.raises(ValueError):
        loaders.load_ledger(spark, f"{path}/users", fmt="stored")


def test_labels_meet_ids_without_an_exchange(spark, stored):
    kept = loaders.load_ledger(spark, stored, fmt="stored")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit = loaders.labelled_ids(kept)
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        want = loaders.labelled_ids(bind(spark, SF, "N"))
        assert rows(hit) == rows(want) != []
        plan = kpis.fraud_counts(kept)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\((id|transaction_id)#", plan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_key_filter_keeps_what_matches_and_little_else(spark):
    df = spark.range(100_000).select((F.col("id") * 7).alias("k"), "id").union(spark.sql("select null, -1L"))
    keys = spark.range(500).select((F.col("id") * 70).alias("k")).union(spark.sql("select cast(null as bigint)"))
    got = may_match(df, keys, "k").select("k").toPandas()["k"]
    assert set(range(0, 35_000, 70)) <= set(got) and len(got) < 700
    assert may_match(df, keys.limit(0), "k").count() == 0
    assert may_match(df, keys, "k", bits=6).where("k % 70 = 0 and k < 35000").count() == 500


def test_only_rows_that_may_match_are_shuffled(spark):
    led = bind(spark, SF, "O")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (kpis.fraud_counts(led), loaders.label_semi_join(led.fraud_labels, led.transactions)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            at = [i for i, x in enumerate(lines) if "BroadcastHashJoin" in x and "__filter" in plan]
            assert at, plan
            assert re.search(r"getbit|bit_get", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
