"""Property tests: random small ledgers against a direct pandas / Decimal
computation of the dashboard's rules (independent of the Spark code and of
the SQL oracle)."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import make_ledger
from spendlens.operators import insights, kpis, merchants, spending
from spendlens.operators import rewards as rw
from spendlens.operators.catalogue import CATALOGUE
from spendlens.sources.bindings import MCC_CATEGORIES, MCC_MAX_LISTED

BASE = dt.datetime(2024, 6, 30, 12, 0, 0)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])

row = st.tuples(
    st.sampled_from([1, 2]),                       # client
    st.integers(0, 400),                           # days back
    st.integers(0, 86399),                         # seconds back
    st.integers(-5000, 60000),                     # cents
    st.integers(1, 50),                            # mcc
    st.integers(1, 6),                             # merchant
)
ledgers = st.lists(row, min_size=1, max_size=40)


def category_of(mcc: int) -> str:
    return MCC_CATEGORIES[mcc % 8] if 1 <= mcc <= MCC_MAX_LISTED else "Other"


def frame(rows) -> pd.DataFrame:
    recs = []
    for i, (c, d, s, cents, mcc, m) in enumerate(rows):
        recs.append({"id": i, "client_id": c, "amount": cents / 100,
                     "cents": cents, "date": BASE - dt.timedelta(days=d, seconds=s),
                     "mcc": mcc, "merchant_id": m})
    return pd.DataFrame(recs)


def to_ledger(spark, df: pd.DataFrame):
    return make_ledger(spark, [(r.id, r.client_id, r.amount, r.date.to_pydatetime(), r.mcc,
                                r.merchant_id) for r in df.itertuples()])


def half_up(x: float, k: int) -> float:
    d = Decimal(repr(x)).quantize(Decimal(1).scaleb(-8), ROUND_HALF_UP)
    return float(d.quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP))


def in_period(df: pd.DataFrame, days: int) -> pd.DataFrame:
    anchor = df.groupby("client_id")["date"].transform("max")
    return df[(df["date"] >= anchor - pd.Timedelta(days=days)) & (df["amount"] > 0)]


@SETTINGS
@given(ledgers)
def test_category_breakdown_matches_pandas(spark, rows):
    df = frame(rows)
    got = {(r.client_id, r.category): r for r in
           spending.category_breakdown(to_ledger(spark, df), "3_months").collect()}
    p = in_period(df, 90).assign(category=lambda x: x["mcc"].map(category_of))
    want = {}
    for c, g in p.groupby("client_id"):
        sums = g.groupby("category")["cents"].agg(["sum", "count"])
        total = int(sums["sum"].sum())
        for cat, (s, n) in sums.iterrows():
            want[(c, cat)] = (s / 100, n, half_up((s / 100) / n, 2),
                              half_up((s / 100) / (total / 100) * 100, 1) if total > 0 else 0.0)
    assert set(got) == set(want)
    for k, (total, n, avg, pct) in want.items():
        r = got[k]
        assert (r.total_spent, r.transaction_count) == (total, n)
        assert r.avg_transaction == pytest.approx(avg, abs=0.0100001)
        assert r.percentage == pytest.approx(pct, abs=0.1000001)


@SETTINGS
@given(ledgers)
def test_merchant_stats_match_pandas(spark, rows):
    df = frame(rows)
    got = {(r.client_id, r.merchant_id): r for r in
           merchants.merchant_stats(to_ledger(spark, df), "3_months").collect()}
    p = in_period(df, 90)
    want = {}
    for (c, m), g in p.groupby(["client_id", "merchant_id"]):
        n = len(g)
        total = g["cents"].sum() / 100
        std = g["amount"].std() if n > 1 else float("nan")
        first = g.sort_values(["date", "id"]).iloc[0]["mcc"]
        want[(c, m)] = (total, n, int(first), round(n / 90 * 30, 2), std)
    assert set(got) == set(want)
    for k, (total, n, mcc, freq, std) in want.items():
        r = got[k]
        assert (r.total_spent, r.transaction_count, r.mcc) == (total, n, mcc)
        assert r.frequency_score == pytest.approx(freq, abs=0.0100001)
        assert r.std_amount == pytest.approx(0.0 if pd.isna(std) else std, abs=0.0100001)
        cv = r.std_amount / r.avg_amount if r.avg_amount > 0 else 0.0
        assert r.consistency_score == pytest.approx(1 / (1 + cv), abs=0.0010001)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3_000_000)), min_size=1,
                max_size=12), st.integers(1, 4))
def test_optimal_portfolio_matches_enumeration(spark, spends, max_cards):
    df = frame([(1, i % 300, 0, cents, mcc, 1) for i, (mcc, cents) in enumerate(spends)])
    got = rw.Rewards(to_ledger(spark, df), "1_year", max_cards).optimal().collect()
    p = in_period(df, 365).assign(category=lambda x: x["mcc"].map(category_of))
    spend = {k: Decimal(int(v)) / 100 for k, v in p.groupby("category")["cents"].sum().items()}
    best, best_net = None, Decimal(0)
    for k in range(1, max_cards + 1):
        for combo in combinations(CATALOGUE, k):
            net = sum(s * max(c.rate(cat) for c in combo) for cat, s in spend.items())
            net -= sum(c.annual_fee for c in combo)
            if net > best_net:
                best, best_net = combo, net
    if best is None:
        assert got == []
    else:
        assert len(got) == 1
        assert got[0].optimal_cards == ", ".join(c.name for c in best)
        assert got[0].net_annual_rewards == float(best_net)


@SETTINGS
@given(ledgers)
def test_comparison_metrics_match_pandas(spark, rows):
    df = frame(rows)
    got = {r.client_id: r for r in
           spending.comparison_metrics(to_ledger(spark, df), "3_months").collect()}
    spend = df[df["amount"] > 0]
    anchor = spend.groupby("client_id")["date"].transform("max")
    cur = spend[spend["date"] >= anchor - pd.Timedelta(days=90)]
    prev = spend[(spend["date"] >= anchor - pd.Timedelta(days=180))
                 & (spend["date"] < anchor - pd.Timedelta(days=90))]
    have = set(in_period(df, 90)["client_id"])   # clients with a row in the F3 window
    assert set(got) == have
    for c in have:
        r = got[c]
        cs, ps = cur[cur.client_id == c]["cents"].sum(), prev[prev.client_id == c]["cents"].sum()
        cn, pn = (cur.client_id == c).sum(), (prev.client_id == c).sum()
        assert (r.current_spending, r.previous_spending) == (cs / 100, ps / 100)
        assert (r.current_transactions, r.previous_transactions) == (cn, pn)
        want = (cs - ps) / ps * 100 if ps > 0 else 0.0
        assert r.spending_change_pct == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r.velocity_per_day == pytest.approx(cn / 90)


@SETTINGS
@given(ledgers)
def test_volatility_and_anomalies_match_pandas(spark, rows):
    df = frame(rows)
    led = to_ledger(spark, df)
    vol = {r.client_id: r for r in merchants.spending_volatility(led, "3_months").collect()}
    p = in_period(df, 90)
    for c, g in p.groupby("client_id"):
        daily = g.groupby(g["date"].dt.date)["cents"].sum() / 100
        r = vol[c]
        if len(daily) < 2:
            assert (r.avg_daily_spending, r.std_daily_spending) == (0.0, 0.0)
        else:
            assert r.avg_daily_spending == pytest.approx(daily.mean(), abs=0.0050001)
            assert r.std_daily_spending == pytest.approx(daily.std(), abs=0.0050001)
            assert r.max_daily_spending == daily.max() and r.min_daily_spending == daily.min()
    got = {(r.client_id, r.id) for r in insights.amount_anomalies(led).collect()}
    spend = df[df["amount"] > 0]
    want = set()
    for c, g in spend.groupby("client_id"):
        if len(g) < 2:
            continue
        th = g["amount"].mean() + 2 * g["amount"].std()
        # exclude values within rounding distance of the threshold
        for r in g.itertuples():
            if abs(r.amount - th) > 1e-6 and r.amount > th:
                want.add((c, r.id))
            elif abs(r.amount - th) <= 1e-6:
                got.discard((c, r.id))
    assert got == want


@SETTINGS
@given(ledgers)
def test_monthly_trend_matches_pandas(spark, rows):
    df = frame(rows)
    got = {(r.client_id, r.position): r.spending
           for r in kpis.monthly_trend(to_ledger(spark, df), 6).collect()}
    anchor = df.groupby("client_id")["date"].max()
    for c, a in anchor.items():
        g = df[(df.client_id == c) & (df.amount > 0)]
        for i in range(6):
            lo, hi = a - pd.Timedelta(days=30 * (i + 1)), a - pd.Timedelta(days=30 * i)
            s = g[(g.date >= lo) & (g.date < hi)]["cents"].sum() / 100
            assert got[(c, 5 - i)] == s


months_rows = st.lists(st.tuples(st.integers(0, 420), st.integers(100, 500000)), min_size=1,
                       max_size=40)


@SETTINGS
@given(months_rows)
def test_linear_forecast_matches_polyfit(spark, pts):
    import numpy as np
    df = frame([(1, d, 0, cents, 8, 1) for d, cents in pts])
    got = {r.step: r for r in insights.linear_forecast(to_ledger(spark, df)).collect()}
    p = in_period(df, 365)
    monthly = p.groupby(p["date"].dt.strftime("%Y-%m"))["cents"].sum().sort_index() / 100
    if len(monthly) < 3:
        assert got == {}
        return
    x = np.arange(len(monthly))
    slope, icpt = np.polyfit(x, monthly.values, 1)
    preds = [max(0.0, slope * (len(monthly) + i) + icpt) for i in range(3)]
    for i, want in enumerate(preds, start=1):
        assert got[i].predicted_spending == pytest.approx(want, abs=1e-5, rel=1e-9)
        assert got[i].slope == pytest.approx(slope, abs=1e-5, rel=1e-9)
    assert got[1].avg_prediction == pytest.approx(sum(preds) / 3, abs=1e-5, rel=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3_000_000)), min_size=1,
                max_size=12))
def test_card_comparison_matches_direct_sums(spark, spends):
    df = frame([(1, i % 300, 0, cents, mcc, 1) for i, (mcc, cents) in enumerate(spends)])
    got = {r.card: r for r in rw.Rewards(to_ledger(spark, df), "1_year").card_comparison()
           .collect()}
    p = in_period(df, 365).assign(category=lambda x: x["mcc"].map(category_of))
    spend = {k: Decimal(int(v)) / 100 for k, v in p.groupby("category")["cents"].sum().items()}
    nets = []
    for i, c in enumerate(CATALOGUE):
        gross = sum(s * c.rate(cat) for cat, s in spend.items())
        nets.append((-(gross - c.annual_fee), i, c.name))
        assert got[c.name].gross_rewards == float(gross)
        assert got[c.name].net_rewards == float(gross - c.annual_fee)
    for rank, (_, _, name) in enumerate(sorted(nets), start=1):
        assert got[name].rank == rank


def _merchant_frame(p: pd.DataFrame, days: int) -> pd.DataFrame:
    g = p.groupby(["client_id", "merchant_id"])
    m = pd.DataFrame({"total": g["cents"].sum() / 100, "n": g.size(),
                      "std": g["amount"].std()}).reset_index()
    m["avg"] = [half_up(t / n, 2) for t, n in zip(m["total"], m["n"])]
    m["std"] = [0.0 if pd.isna(s) else half_up(s, 2) for s in m["std"]]
    m["freq"] = [half_up(n / days * 30, 2) for n in m["n"]]
    m["cons"] = [half_up(1 / (1 + (s / a if a > 0 else 0.0)), 3) for s, a in zip(m["std"], m["avg"])]
    return m


@SETTINGS
@given(ledgers)
def test_loyalty_and_subscriptions_match_pandas(spark, rows):
    df = frame(rows)
    led = to_ledger(spark, df)
    m = _merchant_frame(in_period(df, 90), 90)
    want_loy, want_sub = set(), set()
    for c, g in m.groupby("client_id"):
        ts_, tf = g["total"].quantile(0.7), g["freq"].quantile(0.7)
        for r in g.itertuples():
            near = abs(r.total - ts_) < 1e-9 or abs(r.freq - tf) < 1e-9
            if not near and (r.total >= ts_ or r.freq >= tf):
                want_loy.add((c, r.merchant_id))
            if r.cons > 0.8 and r.freq >= 0.8 and r.n >= 2:
                want_sub.add((c, r.merchant_id))
    got_loy = {(r.client_id, r.merchant_id): r for r in
               merchants.loyalty_candidates(led, "3_months").collect()}
    for c, g in m.groupby("client_id"):   # ties at the threshold are N3 territory: skip them
        ts_, tf = g["total"].quantile(0.7), g["freq"].quantile(0.7)
        for r in g.itertuples():
            if abs(r.total - ts_) < 1e-9 or abs(r.freq - tf) < 1e-9:
                got_loy.pop((c, r.merchant_id), None)
    assert set(got_loy) == want_loy
    got_sub = {(r.client_id, r.merchant_id) for r in
               merchants.subscriptions(led, "3_months").collect()}
    assert got_sub == want_sub


@SETTINGS
@given(ledgers)
def test_patterns_match_pandas(spark, rows):
    df = frame(rows)
    got = {(r.client_id, r.dimension, r.bucket): r for r in
           spending.spending_patterns(to_ledger(spark, df), "3_months").collect()}
    p = in_period(df, 90)
    for c, g in p.groupby("client_id"):
        for name, keys in (("day_of_week", g["date"].dt.day_name()),
                           ("hour", g["date"].dt.hour.astype(str)),
                           ("day_of_month", g["date"].dt.day.astype(str))):
            sums = g.groupby(keys)["cents"].sum() / 100
            for k, v in sums.items():
                assert got[(c, name, k)].amount == v
        a = got[(c, "all", "all")]
        assert a.transactions == len(g) and a.max_transaction == g["amount"].max()


@SETTINGS
@given(ledgers, st.lists(st.tuples(st.integers(0, 39), st.booleans()), max_size=10,
                         unique_by=lambda t: t[0]))
def test_kpis_match_pandas(spark, rows, labels):
    df = frame(rows)
    led = make_ledger(spark, [(r.id, r.client_id, r.amount, r.date.to_pydatetime(), r.mcc,
                               r.merchant_id) for r in df.itertuples()],
                      users=[(1, 1000.0, 700), (2, 0.0, 640)], labels=labels)
    got = {r.client_id: r for r in kpis.all_kpis(led).collect()}
    fraud = {i for i, f in labels if f}
    for c in (1, 2):
        g = df[df.client_id == c]
        r = got[c]
        if g.empty:
            assert (r.total_monthly_spending, r.rewards_earned, r.fraud_risk_score) == (0, 0, 0)
            continue
        a = g["date"].max()
        spend = g[g.amount > 0]

        def window(m):
            return spend[spend.date >= a - pd.Timedelta(days=30 * m)]["cents"].sum()

        assert r.total_monthly_spending == window(1) / 100
        assert r.rewards_earned == pytest.approx(sum(window(m) for m in range(1, 13)) / 100 * 0.01)
        assert r.fraud_risk_score == pytest.approx(g["id"].isin(fraud).sum() / len(g) * 100)
        assert r.interest_paid == pytest.approx(180.0 if c == 1 else 0.0)
        in90 = spend[spend.date >= a - pd.Timedelta(days=90)]
        assert r.spending_categories == in90["mcc"].map(category_of).nunique()


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3_000_000)), min_size=1,
                max_size=12))
def test_extra_rewards_match_direct_computation(spark, spends):
    df = frame([(1, i % 300, 0, cents, mcc, 1) for i, (mcc, cents) in enumerate(spends)])
    r = rw.Rewards(to_ledger(spark, df), "1_year")
    opt = r.optimal().collect()
    got = {x.category: x for x in r.category_extra_rewards().collect()}
    p = in_period(df, 365).assign(category=lambda x: x["mcc"].map(category_of))
    spend = {k: Decimal(int(v)) / 100 for k, v in p.groupby("category")["cents"].sum().items()}
    members = ([c for c in CATALOGUE if c.name in opt[0].optimal_cards.split(", ")]
               if opt else [])
    for cat, s in spend.items():
        rate, card = Decimal("0.01"), "Current Card"
        for c in members:
            if c.rate(cat) > rate:
                rate, card = c.rate(cat), c.name
        x = got[cat]
        assert (x.best_card, x.best_reward_rate) == (card, float(rate) * 100)
        assert x.additional_rewards == float(s * rate - s * Decimal("0.01"))


@SETTINGS
@given(ledgers)
def test_top_merchants_and_trends_match_pandas(spark, rows):
    df = frame(rows)
    led = to_ledger(spark, df)
    top = {(r.client_id, r.merchant_id): r for r in
           spending.top_merchants(led, "3_months", 3).collect()}
    p = in_period(df, 90)
    for c, g in p.groupby("client_id"):
        sums = g.groupby("merchant_id")["cents"].agg(["sum", "count"]).reset_index()
        sums = sums.sort_values(["sum", "merchant_id"], ascending=[False, True]).head(3)
        assert {m for (cc, m) in top if cc == c} == set(sums["merchant_id"])
        for rank, r in enumerate(sums.itertuples(), start=1):
            got = top[(c, r.merchant_id)]
            assert (got.rank, got.total_spent, got.transaction_count) == (rank, r.sum / 100, r.count)
    trends = {(r.client_id, r.month_year, r.category): r.amount for r in
              spending.spending_trends(led, "1_year").collect()}
    y = in_period(df, 365).assign(category=lambda x: x["mcc"].map(category_of),
                                  month=lambda x: x["date"].dt.strftime("%Y-%m"))
    for (c, m, cat), v in y.groupby(["client_id", "month", "category"])["cents"].sum().items():
        assert trends[(c, m, cat)] == v / 100
    for (c, m), v in y.groupby(["client_id", "month"])["cents"].sum().items():
        assert trends[(c, m, None)] == v / 100
