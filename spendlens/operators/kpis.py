"""Overview KPIs (A1–A10), for all clients at once.

Anchor rule: latest transaction of the client, refunds included.  A1, A2 and
A4 come out of one aggregation over the anchored purchases (conditional sums),
instead of one scan per month window; A6 starts from the labels.  Every client of
``users`` gets a row; missing data gives 0, never NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.categories import with_category
from spendlens.functions.cleaning import month_label
from spendlens.functions.exprs import (card_label, cents, cents_to_double, clamp_max,
                                       money_sum, money_sum_dec, round_dec)
from spendlens.functions.periods import days_before, recent, spend_only
from spendlens.plans.joins import attach_per_client, may_match, rank_all
from spendlens.sources.schema import Ledger

MONTH_DAYS = 30
APR = 0.18
BASE_REWARD = 0.01


def _users(ledger: Ledger) -> DataFrame:
    return ledger.users.select(F.col("id").alias("client_id"))


def _in_months(m: int) -> Column:
    """``anchor - 30*m days <= date <= anchor`` on a purchase."""
    return (F.col("amount") > 0) & (F.col("date") >= days_before("anchor", MONTH_DAYS * m))


def reward_weight(months: int = 12, mode: str = "nested") -> Column:
    """A4 weight of a purchase: in how many of the windows m = 1..months it
    falls (nested, as the KPI card sums them), or 1 if in the widest window
    (disjoint)."""
    if mode == "disjoint":
        return F.when(_in_months(months), 1).otherwise(0)
    if mode != "nested":
        raise ValueError(f"unknown mode {mode!r}")
    # The smallest window that holds the purchase, by its age; every wider
    # window up to ``months`` holds it too.
    window = MONTH_DAYS * 86_400_000_000
    micros = "unix_micros(cast({} as timestamp))".format
    smallest = F.greatest(F.expr(f"int(({micros('anchor')} - {micros('date')} + {window - 1}) div {window})"), F.lit(1))
    held = F.greatest(F.lit(months + 1) - smallest, F.lit(0))
    return F.when(F.col("amount") > 0, held).otherwise(0)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def kpi_core(ledger: Ledger, months_back: int = 1, reward_months: int = 12,
             mode: str = "nested") -> DataFrame:
    """One pass over the transactions: per client spend in the last
    ``months_back`` windows (A1) and weighted spend for A4."""
    days = MONTH_DAYS * max(months_back, reward_months)
    tx = spend_only(recent(ledger, days, columns=("client_id", "amount", "date")))
    return tx.groupBy("client_id").agg(
        F.sum(F.when(_in_months(months_back), cents("amount"))).alias("_m"),
        F.sum(cents("amount") * reward_weight(reward_months, mode)).alias("_w"))


def fraud_counts(ledger: Ledger) -> DataFrame:
    """Per client with transactions: fraudulent and all rows (A6).  The join
    starts from the labels: in a stored ledger both sides are bucketed by id and
    nothing is exchanged; elsewhere only transactions whose id may be a label's
    shuffle by id (``may_match``).  A duplicated label fans out, as in a plain
    left merge."""
    if ledger.ids is not None and ledger.labels_by_id is not None:
        labels = ledger.labels_by_id.select(F.col("transaction_id").alias("id"), F.col("labels").alias("_ln"), F.col("frauds").alias("_lf"))
        hit = ledger.ids.join(labels, "id")
    else:
        labels = ledger.fraud_labels.where("transaction_id is not null").groupBy(
            F.col("transaction_id").alias("id")).agg(
            F.count(F.lit(1)).alias("_ln"), F.count_if(F.col("is_fraud")).alias("_lf"))
        ids = may_match(ledger.transactions.select("client_id", "id"), labels.select("id"), "id")
        hit = ids.join(labels, "id").withColumn("n", F.lit(1).cast("long"))
    hit = hit.groupBy("client_id").agg(F.sum((F.col("_ln") - 1) * F.col("n")).alias("_more"),
                                       F.sum(F.col("_lf") * F.col("n")).alias("_f"))
    zero = F.lit(0).cast("long")
    return (ledger.client_activity().select("client_id", "n_transactions").join(hit, "client_id", "left")
            .select("client_id", F.coalesce("_f", zero).alias("_fraud"),
                    (F.col("n_transactions") + F.coalesce("_more", zero)).alias("_n")))


def monthly_spending(ledger: Ledger, months_back: int = 1) -> DataFrame:
    """A1: purchases in the last ``30 * months_back`` days up to the anchor."""
    tx = recent(ledger, MONTH_DAYS * months_back, columns=("client_id", "amount", "date"))
    s = (tx.filter(_in_months(months_back)).groupBy("client_id")
           .agg(money_sum("amount").alias("monthly_spending")))
    return attach_per_client(ledger, _users(ledger), s, "left").select(
        "client_id", _zero("monthly_spending").alias("monthly_spending"))


def _limits(ledger: Ledger) -> DataFrame:
    return ledger.cards.groupBy("client_id").agg(
        money_sum_dec("credit_limit").cast("double").alias("total_credit_limit"))


def utilization_expr(spend: Column, limit: Column) -> Column:
    """A2: spend / limit × 100, capped at 100; 0 without cards or limit."""
    return F.when(limit.isNull() | (limit == 0), F.lit(0.0)).otherwise(
        clamp_max(spend / limit * 100, 100.0))


def credit_utilization(ledger: Ledger) -> DataFrame:
    a1 = monthly_spending(ledger, 1)
    return attach_per_client(ledger, a1, _limits(ledger), "left").select(
        "client_id", "monthly_spending", _zero("total_credit_limit").alias("total_credit_limit"),
        utilization_expr(F.col("monthly_spending"), F.col("total_credit_limit"))
        .alias("credit_utilization"))


def interest_expr(debt: Column, months_back: int = 12, apr: float = APR) -> Column:
    """A3: debt × APR / 12 × months; 0 for NULL or zero debt."""
    return F.when(debt.isNull() | (debt == 0), F.lit(0.0)).otherwise(
        debt * apr / 12 * months_back)


def interest_paid(ledger: Ledger, months_back: int = 12, apr: float = APR) -> DataFrame:
    return ledger.users.select(F.col("id").alias("client_id"), "total_debt",
                               interest_expr(F.col("total_debt"), months_back, apr)
                               .alias("interest_paid"))


def rewards_earned(ledger: Ledger, months_back: int = 12, mode: str = "nested") -> DataFrame:
    """A4: 1 % of the sum over m = 1..months of A1(m) (``mode="nested"``, as
    the reference), or of each purchase once (``"disjoint"``)."""
    core = kpi_core(ledger, 1, months_back, mode)
    return attach_per_client(ledger, _users(ledger), core, "left").select(
        "client_id",
        (F.coalesce(cents_to_double("_w"), F.lit(0.0)) * BASE_REWARD).alias("rewards_earned"))


def fraud_risk(ledger: Ledger) -> DataFrame:
    """A6 (+ J3): fraudulent / all transactions × 100, all time, refunds
    included; unlabelled transactions count as not fraudulent."""
    return attach_per_client(ledger, _users(ledger), fraud_counts(ledger), "left").select(
        "client_id",
        F.coalesce("_n", F.lit(0).cast("long")).alias("transactions"),
        F.coalesce("_fraud", F.lit(0).cast("long")).alias("fraud_transactions"),
        F.when(F.col("_n") > 0, F.col("_fraud") / F.col("_n") * 100).otherwise(F.lit(0.0))
        .alias("fraud_risk_score"))


def spending_by_category(ledger: Ledger, months_back: int = 3) -> DataFrame:
    """A5 + A10: per client × category spend and count over the last
    ``30 * months_back`` days; share of the client's total (1 dp), rank,
    top-10 flag, top-5 share (sum of the rounded shares), category count."""
    tx = recent(ledger, MONTH_DAYS * months_back, columns=("client_id", "mcc", "amount", "date"))
    tx = with_category(tx.filter(_in_months(months_back)), ledger.mcc_codes)
    g = tx.groupBy("client_id", "category").agg(
        money_sum_dec("amount").alias("_d"), F.count(F.lit(1)).alias("transactions"))
    w = Window.partitionBy("client_id")
    tot = F.sum("_d").over(w).cast("double")
    g = g.select("client_id", "category", F.col("_d").cast("double").alias("amount"),
                 "transactions", tot.alias("total_spending"),
                 F.count(F.lit(1)).over(w).alias("category_count"))
    g = g.withColumn("percentage", F.when(F.col("total_spending") > 0, round_dec(
        F.col("amount") / F.col("total_spending") * 100, 1)).otherwise(F.lit(0.0)))
    g = rank_all(g, ["client_id"], [F.col("amount").desc(), F.col("category")])
    top5 = F.sum(F.when(F.col("rank") <= 5, F.col("percentage").cast("decimal(10,1)"))).over(w)
    return (g.withColumn("in_top10", F.col("rank") <= 10)
             .withColumn("top5_share", top5.cast("double")))


def monthly_trend(ledger: Ledger, months: int = 6) -> DataFrame:
    """A7 (+ F7): purchases in fixed 30-day buckets ``[a-30(i+1), a-30i)``
    back from the anchor, i = 0..months-1; the latest transaction itself is in
    no bucket.  ``position`` 0 is the oldest bucket; empty buckets are 0.

    One aggregation per client with a conditional sum per bucket, unpacked
    into one row per bucket: no skeleton join."""
    tx = recent(ledger, MONTH_DAYS * months, columns=("client_id", "amount", "date"))
    sums = []
    for i in range(months):
        inside = ((F.col("amount") > 0)
                  & (F.col("date") >= days_before("anchor", MONTH_DAYS * (i + 1)))
                  & (F.col("date") < days_before("anchor", MONTH_DAYS * i)))
        sums.append(F.sum(F.when(inside, cents("amount"))).alias(f"_b{i}"))
    g = tx.groupBy("client_id").agg(F.max("anchor").alias("anchor"), *sums)
    buckets = F.array(*[F.struct(F.lit(i).alias("bucket"), F.col(f"_b{i}").alias("_c"))
                        for i in range(months)])
    g = g.select("client_id", "anchor", F.inline(buckets))
    start = F.col("anchor") - F.make_dt_interval(days=(F.col("bucket") + 1) * MONTH_DAYS)
    return g.select(
        "client_id", (F.lit(months - 1) - F.col("bucket")).cast("long").alias("position"),
        month_label(start).alias("month"),
        F.coalesce(cents_to_double("_c"), F.lit(0.0)).alias("spending"))


def user_profile(ledger: Ledger) -> DataFrame:
    """A8 + J5: profile fields plus the client's cards, nested (``cards``) and
    as text (``cards_text``: ``id|brand|type|limit|expires`` by card id)."""
    c = ledger.cards
    card = F.struct(F.col("id").alias("card_id"), "card_brand", "card_type", "credit_limit",
                    "expires", card_label("card_brand", "card_type").alias("label"))
    text = F.concat_ws("|", F.col("id").cast("string"), "card_brand", "card_type",
                       F.col("credit_limit").cast("decimal(18,2)").cast("string"),
                       F.date_format("expires", "yyyy-MM-dd"))
    agg = c.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("card_count"),
        F.array_sort(F.collect_list(card)).alias("cards"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))),
                                 lambda x: x["t"]), ";").alias("cards_text"))
    u = ledger.users
    return u.join(agg, u["id"] == agg["client_id"], "left").select(
        u["id"].alias("user_id"), F.col("current_age").alias("age"), "gender", "address",
        "yearly_income", "total_debt", "credit_score", "num_credit_cards",
        F.coalesce("card_count", F.lit(0).cast("long")).alias("card_count"),
        "cards", F.coalesce("cards_text", F.lit("")).alias("cards_text"))


def all_kpis(ledger: Ledger, mode: str = "nested") -> DataFrame:
    """One row per client with A1–A4, A6, the credit score (0 without a
    profile) and the number of categories of A5."""
    core = kpi_core(ledger, 1, 12, mode)
    cats = spending_by_category(ledger, 3).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("spending_categories"))
    u = ledger.users.select(F.col("id").alias("client_id"), "total_debt", "credit_score")
    df = attach_per_client(ledger, u, core, "left")
    df = attach_per_client(ledger, df, fraud_counts(ledger), "left")
    df = attach_per_client(ledger, df, _limits(ledger), "left")
    df = attach_per_client(ledger, df, cats, "left")
    spend = F.coalesce(cents_to_double("_m"), F.lit(0.0))
    return df.select(
        "client_id",
        spend.alias("total_monthly_spending"),
        utilization_expr(spend, F.col("total_credit_limit")).alias("credit_utilization"),
        interest_expr(F.col("total_debt")).alias("interest_paid"),
        (F.coalesce(cents_to_double("_w"), F.lit(0.0)) * BASE_REWARD).alias("rewards_earned"),
        F.coalesce(F.col("credit_score"), F.lit(0)).cast("long").alias("credit_score"),
        F.when(F.col("_n") > 0, F.col("_fraud") / F.col("_n") * 100).otherwise(F.lit(0.0))
        .alias("fraud_risk_score"),
        F.coalesce("spending_categories", F.lit(0).cast("long")).alias("spending_categories"))
