"""Write CSV, read it back, compare."""

from __future__ import annotations

from conftest import make_ledger, ts
from spendlens.operators import rewards as rw
from spendlens.operators import spending
from spendlens.sources import sinks


def test_breakdown_round_trip(spark, tmp_path):
    led = make_ledger(spark, [(1, 7, 12.5, ts(0), 8), (2, 7, 7.25, ts(1), 1),
                              (3, 8, 3.0, ts(0), 49)])
    b = spending.category_breakdown(led, "3_months")
    path = str(tmp_path / "breakdown")
    sinks.write_csv(b, path)
    back = sinks.read_csv(spark, path)
    assert back.columns == b.columns
    got = sorted((r.client_id, r.category, float(r.total_spent)) for r in back.collect())
    want = sorted((str(r.client_id), r.category, r.total_spent) for r in b.collect())
    assert [(str(a), b_, c) for a, b_, c in got] == want


def test_patterns_summary_rows(spark, tmp_path):
    led = make_ledger(spark, [(1, 7, 10.0, ts(0)), (2, 7, 30.5, ts(1))])
    s = sinks.patterns_summary(spending.spending_patterns(led, "3_months"))
    path = str(tmp_path / "patterns")
    sinks.write_csv(s, path)
    got = {r.Metric: r.Value for r in sinks.read_csv(spark, path).collect()}
    assert got == {"Total Transactions": "2", "Average Transaction": "$20.25",
                   "Largest Transaction": "$30.50", "Smallest Transaction": "$10.00"}


def test_action_plan_rows(spark, tmp_path):
    led = make_ledger(spark, [(1, 7, 5000.0, ts(0), 8), (2, 7, 100.0, ts(1), 49)])
    a = sinks.action_plan(rw.Rewards(led, "1_year").category_extra_rewards())
    path = str(tmp_path / "plan")
    sinks.write_csv(a, path)
    rows = sinks.read_csv(spark, path).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.Priority == "1" and r.Current_Rate == "1%" and r.Action.startswith("Use ")
    assert r.Action.endswith("for Eating Places and Restaurants")


def test_merchant_and_rewards_exports_round_trip(spark, tmp_path):
    led = make_ledger(spark, [(1, 7, 120.0, ts(0), 8, 3), (2, 7, 80.0, ts(1), 8, 4),
                              (3, 7, 5000.0, ts(2), 2, 3), (4, 8, 15.0, ts(0), 49, 9)])
    merchants_df = spending.top_merchants(led, "3_months", 10)
    p1 = str(tmp_path / "merchants")
    sinks.write_csv(merchants_df, p1)
    back = {(r.client_id, r.merchant_id): r for r in sinks.read_csv(spark, p1).collect()}
    assert len(back) == merchants_df.count() == 3
    assert float(back[("7", "3")].total_spent) == 5120.0
    analysis = rw.Rewards(led, "1_year").category_extra_rewards()
    p2 = str(tmp_path / "analysis")
    sinks.write_csv(analysis, p2)
    got = sinks.read_csv(spark, p2)
    assert got.columns == analysis.columns and got.count() == analysis.count()
