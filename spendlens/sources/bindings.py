"""Bind the driver's TPC-H-style tables to the five ledger tables.

Three transaction ledgers, because no single table has every trait
(see FIXTURES.md §2):

* ``O`` orders ledger  — one row per line item, client = customer
* ``N`` nation ledger  — same rows, client = the customer's nation
* ``E`` events ledger  — one row per event, client = user

Users, cards, MCC codes and fraud labels are derived by fixed formulas, so
that the DuckDB oracle can rebuild exactly the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.cleaning import with_calendar
from spendlens.sources.schema import (CARDS, FRAUD_LABELS, MCC_CODES, TRANSACTIONS, USERS,
                                      Ledger, conform)

# Card brands by (client + k) % 5, and the eight MCC categories by mcc % 8.
BRANDS = ["Visa", "Mastercard", "Amex", "Discover", "Chase"]
MCC_CATEGORIES = [
    "Eating Places and Restaurants",
    "Service Stations",
    "Grocery Stores, Supermarkets",
    "Book Stores",
    "Amusement Parks, Carnivals, Circuses",
    "Travel",
    "Utilities",
    "Retail",
]
MCC_MAX_LISTED = 45
# Event types → mcc 1..5.
EVENT_MCC = ["click", "error", "purchase", "signup", "view"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _users_from_keys(df: DataFrame, key: str, name: str, debt) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(
        k.alias("id"),
        (F.lit(18) + k % 60).cast("int").alias("current_age"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.col(name).alias("address"),
        (F.lit(20000) + (k * 37) % 80000).cast("double").alias("yearly_income"),
        debt.cast("double").alias("total_debt"),
        (F.lit(500) + (k * 13) % 350).cast("int").alias("credit_score"),
        (k % 4).cast("int").alias("num_credit_cards"),
    )


def _cards_for(users: DataFrame) -> DataFrame:
    """``id % 4`` cards per client, k = 1..n (clients with n = 0 have none)."""
    n = F.col("id") % 4
    k = F.col("k")
    c = F.col("client_id")
    brands = F.array(*[F.lit(b) for b in BRANDS])
    return (users.select(F.col("id").alias("client_id"), n.alias("n"))
                 .filter(F.col("n") >= 1)
                 .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
                 .select(
                     (c * 10 + k).alias("id"),
                     c.alias("client_id"),
                     F.element_at(brands, ((c + k) % 5 + 1).cast("int")).alias("card_brand"),
                     F.when(k % 2 == 1, "Credit").otherwise("Debit").alias("card_type"),
                     F.make_date((F.lit(2024) + (c + k) % 6).cast("int"),
                                 ((c * 3 + k) % 12 + 1).cast("int"), F.lit(1)).alias("expires"),
                     (F.lit(1000) * ((c * 7 + k * 3) % 20)).cast("double").alias("credit_limit"),
                 ))


def _mcc_codes(spark: SparkSession) -> DataFrame:
    cats = F.array(*[F.lit(x) for x in MCC_CATEGORIES])
    return spark.range(1, MCC_MAX_LISTED + 1).select(
        F.col("id").cast("int").alias("mcc"),
        F.element_at(cats, (F.col("id") % 8 + 1).cast("int")).alias("category"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("transaction_id"), (F.col("toxic") == 1).alias("is_fraud"))


def _line_rows(spark: SparkSession, sf_dir: str, client: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    df = (li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(pt, F.col("l_partkey") == F.col("p_partkey")))
    if client == "nation":
        cu = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        df = df.join(cu, F.col("o_custkey") == F.col("c_custkey"))
        cid = F.col("c_nationkey").cast("long")
    else:
        cid = F.col("o_custkey")
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(
        F.col("l_extendedprice"))
    tx = df.select(
        F.col("l_orderkey").alias("id"), cid.alias("client_id"),
        F.col("l_suppkey").alias("merchant_id"), F.col("p_size").alias("mcc"),
        amount.alias("amount"), F.col("o_orderdate").alias("date"))
    return conform(with_calendar(tx), TRANSACTIONS)


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    mcc = F.lit(None).cast("int")
    for i, t in enumerate(EVENT_MCC, start=1):
        mcc = F.when(F.col("event_type") == t, F.lit(i)).otherwise(mcc)
    tx = ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("client_id"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("long").alias("merchant_id"),
        mcc.alias("mcc"), F.col("value").alias("amount"), F.col("ts").alias("date"))
    return conform(with_calendar(tx), TRANSACTIONS)


def orders_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    cu = _read(spark, sf_dir, "customer")
    users = conform(_users_from_keys(cu, "c_custkey", "c_name", F.col("c_acctbal")), USERS)
    return Ledger(users=users, cards=conform(_cards_for(users), CARDS),
                  transactions=_line_rows(spark, sf_dir, "customer"),
                  mcc_codes=conform(_mcc_codes(spark), MCC_CODES),
                  fraud_labels=conform(_labels(spark, sf_dir), FRAUD_LABELS))


def nation_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    na = _read(spark, sf_dir, "nation")
    users = conform(_users_from_keys(na, "n_nationkey", "n_name", F.lit(0.0)), USERS)
    return Ledger(users=users, cards=conform(_cards_for(users), CARDS),
                  transactions=_line_rows(spark, sf_dir, "nation"),
                  mcc_codes=conform(_mcc_codes(spark), MCC_CODES),
                  fraud_labels=conform(_labels(spark, sf_dir), FRAUD_LABELS))


def events_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    ev_users = _read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    cu = _read(spark, sf_dir, "customer").join(ev_users, "c_custkey", "left_semi")
    users = conform(_users_from_keys(cu, "c_custkey", "c_name", F.col("c_acctbal")), USERS)
    return Ledger(users=users, cards=conform(_cards_for(users), CARDS),
                  transactions=_event_rows(spark, sf_dir),
                  mcc_codes=conform(_mcc_codes(spark), MCC_CODES),
                  fraud_labels=conform(_labels(spark, sf_dir), FRAUD_LABELS))


LEDGERS = {"O": orders_ledger, "N": nation_ledger, "E": events_ledger}


def ledger(spark: SparkSession, sf_dir: str, binding: str) -> Ledger:
    return LEDGERS[binding](spark, sf_dir)
