"""Boundary cases of the period rules and KPIs (FIXTURES.md §4)."""

from __future__ import annotations

import pytest

from conftest import make_ledger, rows_by, ts
from spendlens.functions.periods import relative_period
from spendlens.operators import kpis, spending


def test_period_lower_bound_inclusive(spark):
    led = make_ledger(spark, [(1, 7, 10.0, ts(0)), (2, 7, 20.0, ts(90)),
                              (3, 7, 30.0, ts(90, 1))])
    ids = {r.id for r in relative_period(led, "3_months").collect()}
    assert ids == {1, 2}


def test_unknown_period_means_90_days(spark):
    led = make_ledger(spark, [(1, 7, 10.0, ts(0)), (2, 7, 20.0, ts(91))])
    assert {r.id for r in relative_period(led, "fortnight").collect()} == {1}


def test_anchor_includes_refunds(spark):
    # latest row is a refund: the window is anchored on it, then refunds drop
    led = make_ledger(spark, [(1, 7, -5.0, ts(0)), (2, 7, 20.0, ts(30)), (3, 7, 20.0, ts(31))])
    b = spending.category_breakdown(led, "1_month").collect()
    assert len(b) == 1 and b[0].transaction_count == 1 and b[0].total_spent == 20.0


def test_custom_range_end_is_midnight(spark):
    base = ts(0).replace(hour=0, minute=0, second=0)
    led = make_ledger(spark, [(1, 7, 1.0, base), (2, 7, 2.0, base.replace(hour=10))])
    end = base.strftime("%Y-%m-%d")
    rows = spending.filtered_transactions(led, start="2000-01-01", end=end).collect()
    assert {r.id for r in rows} == {1}


def test_monthly_trend_buckets(spark):
    led = make_ledger(spark, [(1, 7, 1.0, ts(0)), (2, 7, 2.0, ts(0, 1)),
                              (3, 7, 4.0, ts(30)), (4, 7, 8.0, ts(60))])
    t = rows_by(kpis.monthly_trend(led, 6), "position", "spending")
    # position 5 = newest bucket [a-30, a): 2 + 4; bucket [a-90, a-60) holds the 60-day row
    assert t[5] == (6.0,) and t[4] == (8.0,) and t[3] == (0.0,)
    assert sum(v[0] for v in t.values()) == 14.0  # the anchor row itself is in no bucket
    assert len(t) == 6


def test_rewards_weights_nested(spark):
    rows = [(1, 7, 1.0, ts(0)), (2, 7, 10.0, ts(30)), (3, 7, 100.0, ts(31)),
            (4, 7, 1000.0, ts(360)), (5, 7, 10000.0, ts(361))]
    led = make_ledger(spark, rows)
    r = kpis.rewards_earned(led, 12).first().rewards_earned
    expected = (1 * 12 + 10 * 12 + 100 * 11 + 1000 * 1 + 10000 * 0) * 0.01
    assert r == pytest.approx(expected)
    d = kpis.rewards_earned(led, 12, mode="disjoint").first().rewards_earned
    assert d == pytest.approx((1 + 10 + 100 + 1000) * 0.01)
    assert d <= r


def test_monthly_spending_and_zero_for_idle_clients(spark):
    led = make_ledger(spark, [(1, 7, 5.0, ts(0)), (2, 7, 7.0, ts(30)), (3, 7, 9.0, ts(31))],
                      users=[(7, 0.0, 700), (8, 0.0, 600)])
    m = rows_by(kpis.monthly_spending(led, 1), "client_id", "monthly_spending")
    assert m == {7: (12.0,), 8: (0.0,)}


def test_utilization_no_cards_zero_limit_and_cap(spark):
    led = make_ledger(
        spark, [(1, 7, 500.0, ts(0)), (2, 8, 500.0, ts(0)), (3, 9, 5000.0, ts(0))],
        cards=[(70, 7, "Visa", "Debit", 1000.0), (80, 8, "Visa", "Debit", 0.0),
               (90, 9, "Visa", "Debit", 1000.0)],
        users=[(7, 0.0, 1), (8, 0.0, 1), (9, 0.0, 1), (10, 0.0, 1)])
    u = rows_by(kpis.credit_utilization(led), "client_id", "credit_utilization")
    assert u == {7: (50.0,), 8: (0.0,), 9: (100.0,), 10: (0.0,)}


def test_interest_null_zero_negative_debt(spark):
    led = make_ledger(spark, [(1, 7, 1.0, ts(0))],
                      users=[(7, 1000.0, 1), (8, 0.0, 1), (9, -100.0, 1), (10, None, 1)])
    i = rows_by(kpis.interest_paid(led), "client_id", "interest_paid")
    assert i[7][0] == pytest.approx(180.0) and i[8] == (0.0,) and i[10] == (0.0,)
    assert i[9][0] == pytest.approx(-18.0)


def test_fraud_label_fan_in(spark):
    led = make_ledger(spark, [(1, 7, 1.0, ts(0)), (2, 7, -1.0, ts(1)), (3, 7, 1.0, ts(2)),
                              (4, 7, 1.0, ts(3))],
                      labels=[(2, False), (3, True)])
    f = kpis.fraud_risk(led).first()
    assert (f.transactions, f.fraud_transactions) == (4, 1)
    assert f.fraud_risk_score == 25.0


def test_null_or_unknown_mcc_is_other(spark):
    led = make_ledger(spark, [(1, 7, 1.0, ts(0), None), (2, 7, 2.0, ts(0), 49),
                              (3, 7, 4.0, ts(0), 8)])
    # make_ledger maps a None mcc to 1; set one explicitly NULL
    from pyspark.sql import functions as F
    led.transactions = led.transactions.withColumn(
        "mcc", F.when(F.col("id") == 1, F.lit(None).cast("int")).otherwise(F.col("mcc")))
    b = rows_by(spending.category_breakdown(led, "3_months"), "category", "total_spent")
    assert b == {"Other": (3.0,), "Eating Places and Restaurants": (4.0,)}


def test_spending_by_category_shares(spark):
    led = make_ledger(spark, [(1, 7, 1.0, ts(0), 8), (2, 7, 2.0, ts(0), 1),
                              (3, 7, 1.0, ts(0), 2)])
    rows = kpis.spending_by_category(led, 3).collect()
    pct = sorted(r.percentage for r in rows)
    assert pct == [25.0, 25.0, 50.0]
    assert {r.top5_share for r in rows} == {100.0}
    assert {r.rank for r in rows} == {1, 2, 3}


def test_patterns_take_a_custom_range(spark):
    base = ts(0).replace(hour=0, minute=0, second=0)
    led = make_ledger(spark, [(1, 7, 10.0, base.replace(hour=9)), (2, 7, 20.0, base),
                              (3, 7, 40.0, ts(20))])
    end = base.strftime("%Y-%m-%d")
    start = ts(5).strftime("%Y-%m-%d")
    p = {r.dimension: r for r in spending.spending_patterns(led, start=start, end=end).collect()
         if r.dimension == "all"}
    assert p["all"].transactions == 1 and p["all"].amount == 20.0


def test_velocity_uses_the_real_period_length(spark):
    rows = [(i, 7, 10.0, ts(i * 5)) for i in range(12)]          # 0..55 days back
    led = make_ledger(spark, rows)
    m6 = spending.comparison_metrics(led, "6_months").first()
    m1 = spending.comparison_metrics(led, "1_month").first()
    assert m6.velocity_per_day == pytest.approx(12 / 180)
    assert m1.current_transactions == 7 and m1.velocity_per_day == pytest.approx(7 / 30)
