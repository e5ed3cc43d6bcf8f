"""Property-style invariants on the driver's sf0.001 tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import kpis, merchants, spending
from spendlens.operators import rewards as rw
from spendlens.sources.bindings import ledger

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")


@pytest.fixture(scope="module")
def led_n(spark):
    return ledger(spark, SF, "N")


@pytest.fixture(scope="module")
def led_e(spark):
    return ledger(spark, SF, "E")


def test_breakdown_total_equals_filtered_total(led_n):
    b = spending.category_breakdown(led_n, "1_year").groupBy("client_id").agg(
        F.sum(F.col("total_spent").cast("decimal(20,2)")).alias("b"))
    f = spending.filtered_transactions(led_n, "1_year").groupBy("client_id").agg(
        F.sum(F.col("amount").cast("decimal(20,2)")).alias("f"))
    bad = b.join(f, "client_id", "full").filter(~F.col("b").eqNullSafe(F.col("f")))
    assert bad.count() == 0


def test_shares_sum_to_100(led_n):
    s = spending.category_breakdown(led_n, "1_year").groupBy("client_id").agg(
        F.sum("percentage").alias("p")).collect()
    assert s and all(abs(r.p - 100.0) <= 0.05 * 20 for r in s)


def test_disjoint_rewards_never_exceed_nested(spark):
    led = ledger(spark, SF, "O")
    n = kpis.rewards_earned(led, 12).withColumnRenamed("rewards_earned", "n")
    d = kpis.rewards_earned(led, 12, mode="disjoint").withColumnRenamed("rewards_earned", "d")
    assert n.join(d, "client_id").filter(F.col("d") > F.col("n") + 1e-9).count() == 0


def test_portfolio_net_monotone_in_max_cards(led_n):
    a = rw.Rewards(led_n, "1_year", 2).optimal().select("client_id", F.col("_net").alias("a"))
    b = rw.Rewards(led_n, "1_year", 4).optimal().select("client_id", F.col("_net").alias("b"))
    assert a.join(b, "client_id", "left").filter(
        F.col("b").isNull() | (F.col("b") < F.col("a"))).count() == 0


@pytest.mark.parametrize("op", [
    lambda led: spending.category_breakdown(led, "3_months"),
    lambda led: merchants.merchant_stats(led, "3_months"),
    lambda led: kpis.monthly_trend(led, 6),
    lambda led: rw.Rewards(led, "1_year").optimal().drop("member_cards"),
])
def test_filter_before_equals_filter_after(spark, led_n, op):
    from spendlens.sources.loaders import client_slice
    cid = led_n.transactions.select(F.min("client_id")).first()[0]
    before = op(client_slice(led_n, cid))
    after = op(led_n).filter(F.col("client_id") == cid)
    cols = sorted(after.columns)
    key = lambda r: repr(r)
    assert sorted(map(tuple, before.select(*cols).collect()), key=key) == \
        sorted(map(tuple, after.select(*cols).collect()), key=key)


def test_spending_trend_totals_roll_up(led_n):
    t = spending.spending_trends(led_n, "1_year")
    cats = t.filter(~F.col("is_total")).groupBy("client_id", "month_year").agg(
        F.sum(F.col("amount").cast("decimal(20,2)")).alias("c"))
    tot = t.filter(F.col("is_total")).select(
        "client_id", "month_year", F.col("amount").cast("decimal(20,2)").alias("t"))
    assert cats.join(tot, ["client_id", "month_year"]).filter(F.col("c") != F.col("t")).count() == 0


def test_pattern_dimensions_share_totals(led_e):
    p = spending.spending_patterns(led_e, "3_months")
    s = p.groupBy("client_id", "dimension").agg(
        F.sum(F.col("amount").cast("decimal(20,2)")).alias("s"), F.sum("transactions").alias("n"))
    assert s.groupBy("client_id").agg(F.countDistinct("s").alias("k"),
                                      F.countDistinct("n").alias("m")) \
        .filter((F.col("k") != 1) | (F.col("m") != 1)).count() == 0
