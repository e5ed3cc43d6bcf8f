"""Exact percentiles by histogram, explicit comparison ranges, portfolio cards,
the bundle's parts, the months band and the CSV quarantine."""

from __future__ import annotations

import os
import random
import shutil

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import make_ledger, rows_by, ts
from spendlens.functions.exprs import payback_months_band
from spendlens.operators import merchants, spending
from spendlens.operators.merchants import client_merchant_totals, loyalty_candidates
from spendlens.operators.rewards import Rewards
from spendlens.plans import registry
from spendlens.plans.quantiles import exact_percentiles, percentile_of
from spendlens.sources import loaders


def frame(spark, groups):
    rows = [(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g long, v double")


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.lists(st.one_of(
    st.integers(-10**7, 10**7).map(lambda x: x / 100), st.just(0.0), st.floats(-1e12, 1e12, allow_subnormal=False)),
    min_size=1, max_size=40), min_size=1), st.sampled_from([0.0, 0.25, 0.7, 1.0]))
def test_percentiles_against_lists(spark, groups, p):
    df = frame(spark, groups)
    got = rows_by(exact_percentiles(df, ["g"], {"v": "q"}, p), "g")
    spark_own = rows_by(df.groupBy("g").agg(F.percentile("v", F.lit(p)).alias("q")), "g")
    for g, v in groups.items():
        assert got[g].q == percentile_of(v, p) == spark_own[g].q


def test_percentile_nulls_and_columns(spark):
    df = spark.sql("select * from values (1, 1.0D, null), (1, 3.0D, null), (2, null, 5.0D) t(g, a, b)")
    got = rows_by(exact_percentiles(df, ["g"], {"a": "qa", "b": "qb"}, 0.5), "g")
    assert (got[1].qa, got[1].qb, got[2].qa, got[2].qb) == (2.0, None, None, 5.0)


def test_one_client_of_many_merchants(spark):
    """10^5 merchants of one client: thresholds as from sorted lists, and the
    values that a task ranks are those of two buckets."""
    n = 100_000
    tx = (spark.range(n).select(
        F.col("id"), F.lit(1).cast("long").alias("client_id"), F.lit(None).cast("long").alias("card_id"),
        (F.col("id") + 100).alias("merchant_id"), F.lit(1).alias("mcc"), F.lit(None).cast("double").alias("zip"),
        ((F.pmod(F.xxhash64("id"), F.lit(5_000_000)) + 1) / 100).alias("amount"),
        F.lit("2024-06-30 12:00:00").cast("timestamp_ntz").alias("date"), F.lit(2024).alias("year"), F.lit(6).alias("month"), F.lit(30).alias("day")))
    led = make_ledger(spark, [(1, 1, 1.0, ts())])
    led.transactions, led.activity = tx, None
    amounts = [r.amount for r in tx.select("amount").collect()]
    row = client_merchant_totals(led).collect()[0]
    assert row.total_merchants == n and row.spending_threshold == percentile_of(amounts, 0.7)
    kept = loyalty_candidates(led).count()
    # Every merchant has one purchase, so each reaches the threshold of frequency.
    assert kept == n
    plan = client_merchant_totals(led)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_ranges_of_one_length_side_by_side(spark):
    assert [x.isoformat() for x in spending.comparison_windows("2024-03-01", "2024-03-31")] == [
        "2024-01-31T00:00:00", "2024-03-01T00:00:00", "2024-03-31T00:00:00"]
    with pytest.raises(ValueError):
        spending.comparison_windows("2024-03-02", "2024-03-01")
    day = lambda s: __import__("datetime").datetime.fromisoformat(s)
    led = make_ledger(spark, [
        (1, 1, 100.0, day("2024-03-01"), 1), (2, 1, 50.0, day("2024-03-31"), 2), (3, 1, 7.0, day("2024-03-31T00:00:01"), 3),
        (4, 1, 40.0, day("2024-02-29T23:59:59"), 1), (5, 1, 60.0, day("2024-01-31"), 4), (6, 1, 9.0, day("2024-01-30"), 1),
        (7, 1, -30.0, day("2024-03-05"), 1), (8, 2, 10.0, day("2024-02-10"), 1)])
    got = spending.comparison_metrics(led, start="2024-03-01", end="2024-03-31").collect()
    assert len(got) == 1  # client 2 has no purchase in the range
    r = got[0]
    assert (r.client_id, r.current_spending, r.previous_spending, r.current_transactions, r.previous_transactions) == (1, 150.0, 100.0, 2, 2)
    assert r.spending_change_pct == 50.0 and r.category_diversity == 2 and r.velocity_per_day == 2 / 30


def test_comparison_reads_the_transactions_once(spark):
    led = make_ledger(spark, [(1, 1, 5.0, ts())])
    led.client_activity()
    led.activity = spark.createDataFrame(led.activity.collect(), led.activity.schema)
    plan = spending.comparison_metrics(led)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("merchant_id") <= 1


def rewards_ledger(spark):
    tx = [(i, 1, 900.0, ts(days=i), 1 + i % 5) for i in range(60)] + [(100, 2, 5.0, ts(), 1)]
    return make_ledger(spark, tx, cards=[(11, 1, "Amex", "Credit", 5000.0), (12, 1, "Visa", "Debit", 0.0)])


def test_every_portfolio_card_has_a_row(spark):
    r = Rewards.of(rewards_ledger(spark), "1_year")
    members = rows_by(r.optimal(), "client_id", "member_cards")
    got = {}
    for x in r.portfolio_cards().orderBy("client_id", "position").collect():
        got.setdefault(x.client_id, []).append(x)
    assert {c: [x.card for x in v] for c, v in got.items()} == {c: m[0] for c, m in members.items()}
    for x in (x for v in got.values() for x in v):
        rates = [y.rate for y in x.rates]
        assert rates == sorted(rates, reverse=True) and [y.rank for y in x.rates] == list(range(1, len(rates) + 1))


def test_bundle_has_all_parts(spark):
    r = Rewards.of(rewards_ledger(spark), "1_year")
    got = rows_by(r.bundle(), "client_id")
    assert [c.card_id for c in got[1].current_cards] == [11, 12] and got[2].current_cards == []
    assert [c.rank for c in got[1].top_categories] == list(range(1, len(got[1].top_categories) + 1))
    assert 1 <= len(got[1].top_categories) <= 5
    assert [d.card for d in got[1].card_details] == [x.card for x in r.portfolio_cards().where("client_id = 1").orderBy("position").collect()]
    assert len(got[1].recommendations) == got[1].recommendation_count > 0
    assert rows_by(r.bundle_figures(), "client_id")[1].total_annual_spending == got[1].total_annual_spending


def test_months_band(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (0.58,), (0.59,), (1.0,), (1.08,), (1.09,)], "y double")
    assert [r[0] for r in df.select(payback_months_band("y")).collect()] == [
        "immediate", "immediate", "quick", "quick", "reasonable", "reasonable", "reasonable", "long"]


def test_quarantine_and_extra_columns(spark, tmp_path):
    with open(os.path.join(tmp_path, "transaction_data.csv"), "w") as f:
        f.write("id,date,client_id,amount,use_chip,merchant_id,mcc,errors\n"
                '1,2024-01-05 10:00:00,7,"$1,204.50",Swipe,5,5411,\n'
                '2,2024-01-06 10:00:00,7,$-40.00,Chip,5,5411,Bad PIN\n'
                "3,yesterday,7,$1.00,Chip,5,5411,\n"
                "x,2024-01-07 10:00:00,,n/a,Chip,5,oops,\n"
                "5,2024-01-08 10:00:00,7,$2.00,Chip,5,5411,a,b,c\n"
                "6,2024-01-09 10:00:00\n"
                "7,2024-01-09 10:00:00,7,$3.00,Chip,?,oops,\n")
    good = loaders.load_table(spark, str(tmp_path), "transactions", "csv", strict=True)
    assert sorted((r.id, r.amount, r.use_chip, r.errors, r.merchant_id, r.mcc) for r in good.collect()) == [
        (1, 1204.5, "Swipe", None, 5, 5411), (2, -40.0, "Chip", "Bad PIN", 5, 5411), (7, 3.0, "Chip", None, None, None)]
    bad = {r.reason: r.record for r in loaders.quarantine(spark, str(tmp_path), "transactions").collect()}
    assert set(bad) == {"date", "id,client_id,amount", "columns"} and '"date":"yesterday"' in bad["date"]
    lines = sorted(r.record for r in loaders.quarantine(spark, str(tmp_path), "transactions").where("reason = 'columns'").collect())
    assert lines == ["5,2024-01-08 10:00:00,7,$2.00,Chip,5,5411,a,b,c", "6,2024-01-09 10:00:00"]
    lenient = loaders.load_table(spark, str(tmp_path), "transactions", "csv")
    assert lenient.count() == 7 and lenient.columns[-2:] == ["use_chip", "errors"]


def test_merchant_summary_is_its_parts(spark):
    """Against the separate operators, with refunds, rows without a merchant and
    a client with none but such."""
    rng = random.Random(5)
    tx = [(i, 1 + i % 4, rng.randrange(-500, 9000) / 100, ts(rng.randrange(80), rng.randrange(9)), 1, rng.randrange(40))
          for i in range(400)]
    tx += [(900, 7, 5.0, ts(1), 1, 3), (901, 7, -5.0, ts(2), 1, 4), (902, 8, 3.0, ts(1), 1, 777), (903, 1, 2.5, ts(3), 1, 777)]
    led = make_ledger(spark, tx)
    led.transactions = led.transactions.withColumn("merchant_id", F.when(F.col("merchant_id") != 777, F.col("merchant_id")))
    got = rows_by(merchants.merchant_summary(led), "client_id")
    n = rows_by(merchants.merchant_stats(led).groupBy("client_id").count(), "client_id", "count")
    conc = rows_by(merchants.concentration(led), "client_id")
    loy = rows_by(loyalty_candidates(led).groupBy("client_id").count(), "client_id", "count")
    vol = rows_by(merchants.spending_volatility(led), "client_id")
    assert set(got) == set(n) == {1, 2, 3, 4, 7}
    for c, r in got.items():
        assert (r.total_merchants,) == n[c] and (r.loyalty_candidates,) == loy.get(c, (0,))
        for k in (3, 5, 10):
            assert r[f"top_{k}_percentage"] == (conc[c][f"top_{k}_percentage"] if c in conc else 0.0)
        for x in ("avg_daily_spending", "std_daily_spending", "max_daily_spending", "min_daily_spending",
                  "volatility_coefficient"):
            assert r[x] == vol[c][x]


def test_merchant_summary_reads_transactions_once(spark, tmp_path):
    led = make_ledger(spark, [(i, i % 3, 1.0 + i, ts(i % 50), 1, i % 7) for i in range(60)])
    path = str(tmp_path / "tx")
    led.transactions.write.parquet(path)
    led.transactions, led.activity = spark.read.parquet(path), led.client_activity()
    plan = merchants.merchant_summary(led)._jdf.queryExecution().executedPlan()
    plan.execute().count()
    final = plan.toString().split("== Initial Plan ==")[0]
    assert sum("parquet" in x and "Scan" in x for x in final.splitlines()) == 1


def test_ledger_follows_its_input(spark, tmp_path):
    """Tables that change under one application are read anew."""
    src, sf = "/root/testdata/sf0.001", str(tmp_path)
    if not os.path.isdir(src):
        pytest.skip("no test tables")
    for f in os.listdir(src):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(src, f), sf)
            os.chmod(os.path.join(sf, f), 0o644)
    first = registry.get_ledger(spark, sf, "O")
    assert registry.get_ledger(spark, sf, "O") is first
    before = first.transactions.count()
    orders = os.path.join(sf, "orders.parquet")
    pq.write_table(pq.read_table(orders).slice(0, 100), orders)
    after = registry.get_ledger(spark, sf, "O")
    assert after is not first and after.transactions.count() < before
