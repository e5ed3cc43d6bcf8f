"""C1–C6 and the CSV loader (S1, S4, S5) on literal text."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from spendlens.functions import cleaning
from spendlens.sources import loaders


def test_currency_and_month_year(spark):
    df = spark.createDataFrame(
        [("$1,234.50", "9/2022"), ("$-12.50", "13/2022"), ("", "09/2022"), ("abc", None)],
        "amount string, expires string")
    out = df.select(cleaning.parse_currency("amount").alias("a"),
                    cleaning.parse_month_year("expires").alias("e")).collect()
    assert [r.a for r in out] == [1234.5, -12.5, None, None]
    assert [r.e for r in out] == [dt.date(2022, 9, 1), None, dt.date(2022, 9, 1), None]


def test_timestamp_and_int_casts(spark):
    df = spark.createDataFrame([("2010-01-01 00:01:00", "42"), ("junk", "3.0"), (None, "")],
                               "d string, i string")
    out = df.select(cleaning.parse_timestamp("d").alias("d"),
                    cleaning.parse_int("i").alias("i")).collect()
    assert out[0].d == dt.datetime(2010, 1, 1, 0, 1, 0)
    assert out[1].d is None and out[2].d is None
    assert [r.i for r in out] == [42, None, None]
    assert dict(df.select(cleaning.parse_timestamp("d").alias("d")).dtypes)["d"] == "timestamp_ntz"


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 4, 13, 5),)], "date timestamp_ntz")
    r = cleaning.with_calendar(df).select(
        "year", "month", "day", cleaning.day_name("date").alias("dn"),
        cleaning.month_key("date").alias("mk"), cleaning.month_label("date").alias("ml"),
        F.hour("date").alias("h")).first()
    assert (r.year, r.month, r.day, r.dn, r.mk, r.ml, r.h) == (
        2024, 3, 4, "Monday", "2024-03", "March 2024", 13)


def _write(path, name, text):
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


@pytest.fixture()
def csv_dir(tmp_path):
    d = str(tmp_path)
    _write(d, "users_cards.csv",
           "id,current_age,retirement_age,birth_year,birth_month,gender,address,latitude,"
           "longitude,per_capita_income,yearly_income,total_debt,credit_score,num_credit_cards\n"
           '1,53,66,1966,11,Female,"1 Main St",34.15,-117.76,"$29,278","$59,696","$127,613",787,5\n'
           "2,40,67,1984,1,Male,2 Side St,40.1,-73.2,$10,$20,$0,650,1\n")
    _write(d, "cards_data.csv",
           "id,client_id,card_brand,card_type,expires,cvv,num_cards_issued,credit_limit,"
           "acct_open_date,year_pin_last_changed\n"
           "10,1,Visa,Debit,12/2022,623,2,\"$24,295\",9/2002,2008\n"
           "11,1,Amex,Credit,13/2022,111,1,$0,1/2010,2012\n")
    _write(d, "transaction_data.csv",
           "id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,zip,mcc\n"
           "7475327,2010-01-01 00:01:00,1,10,$-77.00,Swipe,59935,Beulah,58523.0,5499\n"
           "7475328,2010-01-01 00:02:00,1,10,\"$1,204.50\",Swipe,67570,La Verne,91750.0,5311\n"
           "7475329,not a date,2,11,abc,Chip,27092,Vista,92084.0,\n")
    _write(d, "mcc_codes.csv", "mcc,category\n5499,Miscellaneous Food Stores\n5311,Department Stores\n")
    _write(d, "train_fraud_labels.csv", "transaction_id,is_fraud\n7475327,No\n7475328,Yes\n")
    return d


def test_csv_loader_types_and_values(spark, csv_dir):
    led = loaders.load_ledger(spark, csv_dir, "csv")
    tx = {r.id: r for r in led.transactions.collect()}
    assert tx[7475327].amount == -77.0 and tx[7475328].amount == 1204.5
    assert tx[7475327].date == dt.datetime(2010, 1, 1, 0, 1, 0)
    assert (tx[7475327].year, tx[7475327].month, tx[7475327].day) == (2010, 1, 1)
    assert tx[7475329].amount is None and tx[7475329].date is None and tx[7475329].mcc is None
    u = {r.id: r for r in led.users.collect()}
    assert u[1].yearly_income == 59696.0 and u[1].total_debt == 127613.0
    assert u[2].total_debt == 0.0
    c = {r.id: r for r in led.cards.collect()}
    assert c[10].credit_limit == 24295.0 and c[10].expires == dt.date(2022, 12, 1)
    assert c[11].expires is None and c[11].acct_open_date == dt.date(2010, 1, 1)
    lab = {r.transaction_id: r.is_fraud for r in led.fraud_labels.collect()}
    assert lab == {7475327: False, 7475328: True}
    assert dict(led.transactions.dtypes)["date"] == "timestamp_ntz"


def test_csv_and_parquet_give_same_ledger(spark, csv_dir, tmp_path):
    led = loaders.load_ledger(spark, csv_dir, "csv")
    pq = str(tmp_path / "pq")
    for name, stem in loaders.FILE_STEMS.items():
        getattr(led, name).write.parquet(os.path.join(pq, f"{stem}.parquet"))
    led2 = loaders.load_ledger(spark, pq, "parquet")
    for name in loaders.FILE_STEMS:
        a, b = getattr(led, name), getattr(led2, name)
        assert a.schema == b.schema
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_guards(spark, csv_dir):
    with pytest.raises(ValueError):
        loaders.load_ledger(spark, None)
    led = loaders.load_ledger(spark, csv_dir, "csv")
    loaders.require_user(led, 1)
    with pytest.raises(ValueError, match="not found"):
        loaders.require_user(led, 999)


def test_client_slice_and_typed_empty_labels(spark, csv_dir):
    led = loaders.load_ledger(spark, csv_dir, "csv")
    s = loaders.client_slice(led, 1)
    assert {r.client_id for r in s.transactions.collect()} == {1}
    assert s.fraud_labels.count() == 2
    s3 = loaders.client_slice(led, 3)  # no transactions: empty but typed labels
    assert s3.fraud_labels.count() == 0
    assert s3.fraud_labels.schema == led.fraud_labels.schema


def test_user_list_is_ordered_and_may_be_limited(spark, csv_dir):
    led = loaders.load_ledger(spark, csv_dir, "csv")
    out = loaders.user_list(led, limit=1).collect()
    assert [(r.id, r.label) for r in out] == [(1, "User 1 - 1 Main St")]


def test_timestamp_parse_ignores_session_time_zone(spark):
    df = spark.createDataFrame([("2021-03-14 02:30:00",), ("2021-02-30 10:00:00",),
                                ("2021-3-14 02:30:00",), ("2021-03-14T02:30:00",)], "d string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = [r.t for r in df.select(cleaning.parse_timestamp("d").alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert out == [dt.datetime(2021, 3, 14, 2, 30), None, None, None]
