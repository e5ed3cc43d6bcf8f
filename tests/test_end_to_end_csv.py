"""Raw header-CSV files in the dashboard's formats → ledger → analyses."""

from __future__ import annotations

import os

import pytest

from spendlens.operators import insights, kpis, merchants, spending
from spendlens.operators.rewards import Rewards
from spendlens.sources.loaders import load_ledger

TX = [  # id, date, client, card, amount, merchant, mcc
    (1, "2023-01-05 10:00:00", 1, 11, "$120.00", 501, 5812),
    (2, "2023-02-05 10:00:00", 1, 11, "$80.50", 501, 5812),
    (3, "2023-03-05 10:00:00", 1, 11, "$1,204.50", 777, 5411),
    (4, "2023-03-20 09:30:00", 1, 12, "$-40.00", 777, 5411),
    (5, "2023-03-28 18:45:00", 1, 12, "$15.99", 9, 4899),
    (6, "2023-03-29 08:00:00", 2, 21, "$60.00", 600, 5541),
    (7, "2023-03-30 08:00:00", 2, 21, "$60.00", 600, 5541),
]


@pytest.fixture()
def data_dir(tmp_path):
    d = str(tmp_path)
    with open(os.path.join(d, "users_cards.csv"), "w") as f:
        f.write("id,current_age,gender,address,yearly_income,total_debt,credit_score,"
                "num_credit_cards\n1,40,Female,1 Main St,\"$59,696\",\"$1,000\",780,2\n"
                "2,30,Male,2 Side St,$20000,$0,640,1\n")
    with open(os.path.join(d, "cards_data.csv"), "w") as f:
        f.write("id,client_id,card_brand,card_type,expires,credit_limit,acct_open_date\n"
                "11,1,Amex,Credit,12/2026,\"$5,000\",01/2015\n"
                "12,1,Visa,Debit,3/2027,$0,07/2019\n21,2,Discover,Credit,09/2025,$2000,02/2020\n")
    with open(os.path.join(d, "transaction_data.csv"), "w") as f:
        f.write("id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,"
                "merchant_state,zip,mcc,errors\n")
        for i, dt_, c, card, amt, m, mcc in TX:
            f.write(f'{i},{dt_},{c},{card},"{amt}",Swipe,{m},Town,CA,90001.0,{mcc},\n')
    with open(os.path.join(d, "mcc_codes.csv"), "w") as f:
        f.write("mcc,category\n5812,Eating Places and Restaurants\n"
                "5411,\"Grocery Stores, Supermarkets\"\n5541,Service Stations\n")
    with open(os.path.join(d, "train_fraud_labels.csv"), "w") as f:
        f.write("transaction_id,is_fraud\n1,No\n3,Yes\n6,No\n")
    return d


def test_csv_ledger_through_the_analyses(spark, data_dir):
    led = load_ledger(spark, data_dir, "csv")
    k = {r.client_id: r for r in kpis.all_kpis(led).collect()}
    # client 1: anchor 2023-03-28 18:45; last 30 days hold ids 3 and 5 (4 is a refund)
    assert k[1].total_monthly_spending == pytest.approx(1204.50 + 15.99)
    assert k[1].credit_utilization == pytest.approx((1204.50 + 15.99) / 5000 * 100)
    assert k[1].interest_paid == pytest.approx(1000 * 0.18)
    assert k[1].fraud_risk_score == pytest.approx(100 / 5)
    assert k[2].credit_score == 640 and k[2].interest_paid == 0.0
    b = {(r.client_id, r.category): r.total_spent
         for r in spending.category_breakdown(led, "3_months").collect()}
    assert b[(1, "Grocery Stores, Supermarkets")] == 1204.50
    assert b[(1, "Other")] == 15.99 and b[(2, "Service Stations")] == 120.0
    m = {(r.client_id, r.merchant_id): r for r in merchants.merchant_stats(led).collect()}
    assert m[(1, 9)].merchant_name == "Netflix Subscription"
    assert m[(2, 600)].consistency_score == 1.0
    r = Rewards.of(led, "1_year")
    cur = {(x.client_id, x.category): x.current_rate for x in r.current_rewards().collect()}
    assert cur[(1, "Eating Places and Restaurants")] == 0.03  # Amex rule
    assert cur[(2, "Service Stations")] == 0.05               # Discover rule
    assert {x.client_id for x in r.optimal().collect()} == {1, 2}
    assert insights.amount_anomalies(led).count() == 0
