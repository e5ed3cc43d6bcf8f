"""Merchant scores, volatility, forecast and anomaly boundary cases."""

from __future__ import annotations

import pytest

from conftest import make_ledger, rows_by, ts
from spendlens.operators import insights, merchants, spending


def test_single_purchase_consistency_and_no_anomaly(spark):
    led = make_ledger(spark, [(1, 7, 50.0, ts(0), 8, 3)])
    m = merchants.merchant_stats(led, "3_months").first()
    assert m.std_amount == 0.0 and m.consistency_score == 1.0
    assert m.merchant_name == "Starbucks Coffee"
    assert insights.amount_anomalies(led).count() == 0


def test_merchant_scores_and_first_mcc(spark):
    rows = [(1, 7, 10.0, ts(10), 8, 42), (2, 7, 30.0, ts(5), 1, 42), (3, 7, 20.0, ts(0), 2, 42)]
    led = make_ledger(spark, rows)
    m = merchants.merchant_stats(led, "3_months").first()
    assert m.total_spent == 60.0 and m.avg_amount == 20.0 and m.std_amount == 10.0
    assert m.mcc == 8 and m.category == "Eating Places and Restaurants"
    assert m.consistency_score == round(1 / (1 + 10 / 20), 3)
    assert m.frequency_score == 1.0
    assert m.merchant_name == "Eating Places and Restaurants Merchant 42"


def test_subscriptions_need_longer_period(spark):
    rows = [(i, 7, 9.99, ts(i * 7), 8, 9) for i in range(10)]
    led = make_ledger(spark, rows)
    assert merchants.subscriptions(led, "3_months").count() == 1
    assert merchants.subscriptions(led, "1_month").count() == 0


def test_volatility_one_day_is_zero(spark):
    led = make_ledger(spark, [(1, 7, 5.0, ts(0)), (2, 7, 6.0, ts(0, 60))])
    v = merchants.spending_volatility(led, "3_months").first()
    assert (v.avg_daily_spending, v.std_daily_spending, v.max_daily_spending,
            v.min_daily_spending, v.volatility_coefficient) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_volatility_two_days(spark):
    led = make_ledger(spark, [(1, 7, 10.0, ts(0)), (2, 7, 30.0, ts(2))])
    v = merchants.spending_volatility(led, "3_months").first()
    assert v.avg_daily_spending == 20.0 and v.max_daily_spending == 30.0
    assert v.std_daily_spending == pytest.approx(14.14, abs=0.005)
    assert v.volatility_coefficient == pytest.approx(0.707, abs=0.0005)


def test_forecast_needs_three_months_and_clamps(spark):
    two = make_ledger(spark, [(1, 7, 10.0, ts(0)), (2, 7, 10.0, ts(40))])
    assert insights.linear_forecast(two).count() == 0
    base = ts(0)
    falling = make_ledger(spark, [
        (1, 7, 300.0, base.replace(month=4, day=15)), (2, 7, 200.0, base.replace(month=5, day=15)),
        (3, 7, 100.0, base.replace(month=6, day=15))])
    f = rows_by(insights.linear_forecast(falling), "step", "predicted_spending", "slope")
    assert f[1] == (0.0, -100.0) and f[2][0] == 0.0 and f[3][0] == 0.0


def test_anomaly_threshold(spark):
    rows = [(i, 7, 10.0, ts(i)) for i in range(1, 20)] + [(99, 7, 1000.0, ts(0))]
    led = make_ledger(spark, rows)
    a = insights.amount_anomalies(led).collect()
    assert [r.id for r in a] == [99]
    tl = insights.anomaly_timeline(led, last=5).collect()
    assert len(tl) == 5 and {r.position for r in tl} == {1, 2, 3, 4, 5}
    assert [r.id for r in sorted(tl, key=lambda r: r.position)][:2] == [99, 1]


def test_loyalty_and_concentration(spark):
    rows = [(i, 7, float(10 * m), ts(i), 8, m) for m in range(1, 6) for i in range(m)]
    led = make_ledger(spark, rows)
    c = merchants.concentration(led, "3_months").first()
    # totals 10, 40, 90, 160, 250 of 550
    assert c.top_3_percentage == round(500 / 550 * 100, 1) and c.top_10_percentage == 100.0
    loy = {r.merchant_id for r in merchants.loyalty_candidates(led, "3_months").collect()}
    assert loy == {4, 5}


def test_top_merchants_headline(spark):
    rows = [(1, 7, 100.0, ts(0), 1, 1), (2, 7, 1.0, ts(0), 1, 2), (3, 7, 1.0, ts(1), 1, 2),
            (4, 7, 50.0, ts(2), 1, 3)]
    led = make_ledger(spark, rows)
    t = rows_by(spending.top_merchants(led, "3_months", 2), "merchant_id", "rank",
                "most_frequent_merchant", "top3_share")
    assert set(t) == {1, 3}
    assert t[1] == (1, "Merchant 1", 100.0)


def test_approximate_percentile_switches(spark):
    rows = [(i, 7, float(10 + i), ts(i % 20), 1 + i % 8, 1 + i % 5) for i in range(40)]
    led = make_ledger(spark, rows)
    exact = {r.category: r.frequent for r in spending.category_insights(led, "3_months").collect()}
    approx = {r.category: r.frequent
              for r in spending.category_insights(led, "3_months", approx=True).collect()}
    assert set(exact) == set(approx)
    loy = {r.merchant_id for r in merchants.loyalty_candidates(led, "3_months").collect()}
    loy_a = {r.merchant_id
             for r in merchants.loyalty_candidates(led, "3_months", approx=True).collect()}
    assert loy and loy_a


def test_one_month_recommendations_have_loyalty_only(spark):
    rows = [(i, 7, 9.99, ts(i * 3), 8, 9) for i in range(10)] + [(99, 7, 50.0, ts(1), 2, 3)]
    led = make_ledger(spark, rows)
    three = {r.type for r in merchants.merchant_recommendations(led, "3_months").collect()}
    one = {r.type for r in merchants.merchant_recommendations(led, "1_month").collect()}
    assert three == {"Subscription Optimization", "Loyalty Programs"}
    assert one == {"Loyalty Programs"}
