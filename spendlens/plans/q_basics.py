"""Registered source / cleaning / join / band queries (S2, S3, S7, C1–C14,
C19–C23, J1, J4) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.functions import cleaning
from spendlens.functions.categories import (FALLBACK_MAPS, with_category,
                                            with_fallback_category)
from spendlens.functions.exprs import (credit_band, fraud_band, gauge_step, money_sum_dec,
                                       utilization_band)
from spendlens.functions.periods import with_anchor
from spendlens.operators import kpis
from spendlens.plans.registry import register
from spendlens.plans.q_kpis import ALL_KPIS_SQL
from spendlens.plans.sqlkit import MS, anchor_cte, q, with_ledger
from spendlens.sources import loaders


@register("user_list", "O", "S2", with_ledger("O") + (
    "SELECT id, 'User ' || CAST(id AS VARCHAR) || ' - ' || COALESCE(address, '') AS label "
    "FROM users"))
def user_list(led):
    return loaders.user_list(led)


@register("client_slice", "O", "S3, F1, S6", with_ledger("O") + (
    "SELECT t.id, t.client_id, t.merchant_id, t.mcc, t.amount, t.date, t.year, t.month, t.day "
    "FROM tx t WHERE t.client_id IN (SELECT id FROM users)"), ts=("date",))
def client_slice(led):
    s = loaders.client_slice(led)
    tx = s.transactions.join(s.users.select(F.col("id").alias("client_id")), "client_id",
                             "left_semi")
    return tx.select("id", "client_id", "merchant_id", "mcc", "amount", "date", "year", "month",
                     "day")


@register("current_portfolio", "O", "R3", with_ledger("O") + (
    "SELECT client_id, id AS card_id, card_brand, card_type, credit_limit FROM cards"))
def current_portfolio(led):
    return loaders.current_portfolio(led)


@register("single_client_slice", "O", "S3, F1, J4", with_ledger("O") + (
    "SELECT t.id, t.amount FROM tx t WHERE t.client_id = 7"))
def single_client_slice(led):
    return loaders.client_slice(led, 7).transactions.select("id", "amount")


@register("empty_label_slice", "O", "S6", with_ledger("O") + (
    "SELECT CAST(NULL AS BIGINT) AS transaction_id, false AS is_fraud WHERE false"))
def empty_label_slice(led):
    return loaders.client_slice(led, -1).fraud_labels


@register("activity_counts", "O", "S7", with_ledger(
    "O",
    "tc AS (SELECT client_id, COUNT(*) AS n FROM tx GROUP BY client_id)",
    "cc AS (SELECT client_id, COUNT(*) AS n FROM cards GROUP BY client_id)") + (
    "SELECT u.id AS client_id, COALESCE(tc.n, 0) AS transactions, COALESCE(cc.n, 0) AS cards "
    "FROM users u LEFT JOIN tc ON tc.client_id = u.id LEFT JOIN cc ON cc.client_id = u.id"))
def activity_counts(led):
    return loaders.activity_counts(led)


@register("clean_currency_dates", "O", "S1, C1, C2, C3, C4, C5", with_ledger("O") + (
    "SELECT id, client_id, merchant_id, mcc, amount, date, "
    "strftime(date_trunc('month', date), '%Y-%m-%d') AS month_start, year, month, day FROM tx"), ts=("date",))
def clean_currency_dates(led):
    raw = loaders.render_raw_transactions(led.transactions)
    df = loaders.parse_raw_transactions(raw)
    return df.select("id", "client_id", "merchant_id", "mcc", "amount", "date",
                     F.date_format("month_start", "yyyy-MM-dd").alias("month_start"),
                     "year", "month", "day")


@register("calendar_parts", "E", "C5, C6, C7, C8, C9, C10, C11", with_ledger("E", anchor_cte()) + (
    "SELECT t.client_id, t.id, CAST(year(t.date) AS INTEGER) AS year, "
    "CAST(month(t.date) AS INTEGER) AS month, CAST(day(t.date) AS INTEGER) AS day, "
    "dayname(t.date) AS day_name, CAST(hour(t.date) AS INTEGER) AS hour, "
    "strftime(t.date, '%Y-%m') AS month_key, strftime(t.date, '%B %Y') AS month_label, "
    "strftime(t.date, '%Y-%m-%d') AS calendar_date, "
    "strftime(t.date - INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS minus_30_days, "
    "CAST((epoch_us(a.anchor) - epoch_us(t.date)) // 86400000000 AS BIGINT) AS days_to_anchor "
    "FROM tx t JOIN anch a ON a.client_id = t.client_id"))
def calendar_parts(led):
    df = with_anchor(led, led.transactions.select("client_id", "id", "date"))
    d = F.col("date")
    return df.select(
        "client_id", "id", F.year(d).alias("year"), F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"), cleaning.day_name(d).alias("day_name"),
        F.hour(d).alias("hour"), cleaning.month_key(d).alias("month_key"),
        cleaning.month_label(d).alias("month_label"),
        F.date_format(F.to_date(d), "yyyy-MM-dd").alias("calendar_date"),
        F.date_format(d - F.make_dt_interval(days=F.lit(30)), "yyyy-MM-dd HH:mm:ss")
        .alias("minus_30_days"),
        F.floor(F.timestamp_diff("MICROSECOND", d, F.col("anchor")) / 86400000000)
        .cast("long").alias("days_to_anchor"))


@register("category_join", "O", "J1, C12", with_ledger("O") + (
    "SELECT t.id, t.client_id, t.mcc, COALESCE(m.category, 'Other') AS category, t.amount, t.date "
    "FROM tx t LEFT JOIN mcc m ON m.mcc = t.mcc"), ts=("date",))
def category_join(led):
    return with_category(led.transactions, led.mcc_codes).select(
        "id", "client_id", "mcc", "category", "amount", "date")


@register("label_semi_join", "O", "J4", with_ledger("O") + (
    "SELECT f.transaction_id, f.is_fraud FROM fraud f WHERE f.transaction_id IN "
    "(SELECT id FROM tx)"))
def label_semi_join(led):
    return loaders.label_semi_join(led.fraud_labels, led.transactions)


def _fallback_case(which: str) -> str:
    m = FALLBACK_MAPS[which]
    return ("COALESCE(CASE mcc " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in m.items())
            + " END, 'Other')")


@register("fallback_categories", "O", "C14", with_ledger(
    "O",
    "fb AS (" + " UNION ALL ".join(
        f"SELECT client_id, {q(w)} AS map, {_fallback_case(w)} AS category, amount FROM tx"
        for w in FALLBACK_MAPS) + ")") + (
    f"SELECT client_id, map, category, COUNT(*) AS transactions, {MS('amount')} AS amount "
    "FROM fb GROUP BY client_id, map, category"))
def fallback_categories(led):
    out = None
    for w in FALLBACK_MAPS:
        df = with_fallback_category(led.transactions, w).withColumn("map", F.lit(w))
        out = df if out is None else out.unionByName(df)
    return (out.groupBy("client_id", "map", "category")
               .agg(F.count(F.lit(1)).alias("transactions"),
                    money_sum_dec("amount").cast("double").alias("amount")))


@register("kpi_bands", "O", "C19, C20, C21, C22, C23", (
    "SELECT client_id, credit_utilization, CASE WHEN credit_utilization < 30 THEN 'Good' "
    "ELSE 'High' END AS utilization_band, credit_score, CASE WHEN credit_score >= 750 THEN "
    "'Excellent' WHEN credit_score >= 650 THEN 'Good' ELSE 'Fair' END AS credit_band, "
    "fraud_risk_score, CASE WHEN fraud_risk_score < 5 THEN 'low' WHEN fraud_risk_score < 15 "
    "THEN 'moderate' ELSE 'high' END AS fraud_band, CASE WHEN fraud_risk_score < 25 THEN "
    "'lightgreen' WHEN fraud_risk_score < 50 THEN 'yellow' WHEN fraud_risk_score < 75 THEN "
    "'orange' ELSE 'red' END AS gauge_step FROM (" + ALL_KPIS_SQL + ") k"))
def kpi_bands(led):
    k = kpis.all_kpis(led)
    return k.select(
        "client_id", "credit_utilization", utilization_band("credit_utilization")
        .alias("utilization_band"), "credit_score", credit_band("credit_score")
        .alias("credit_band"), "fraud_risk_score", fraud_band("fraud_risk_score")
        .alias("fraud_band"), gauge_step("fraud_risk_score").alias("gauge_step"))
