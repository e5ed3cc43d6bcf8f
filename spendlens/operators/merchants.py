"""Merchant intelligence (M1–M11), for all clients at once.

Period rule F10: anchor = latest transaction of the client (refunds
included), window ``[anchor - days, anchor]``; ``'Last Year'`` and
``'1_year'`` both mean 365 days.  Scores are computed from the rounded mean
and standard deviation, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.categories import with_category
from spendlens.functions.exprs import (money, money_sum_dec, money_text, pct_text, round_dec,
                                       truncate_label)
from spendlens.functions.periods import period_days, relative_period
from spendlens.plans.joins import attach_per_client, top_k_per_group
from spendlens.plans.quantiles import exact_percentiles
from spendlens.sources.schema import Ledger

# Display names of merchant ids 1–10.
MERCHANT_NAMES = {
    1: "Walmart Supercenter",
    2: "Shell Gas Station",
    3: "Starbucks Coffee",
    4: "Amazon.com",
    5: "McDonald's",
    6: "Target Store",
    7: "Kroger Grocery",
    8: "Home Depot",
    9: "Netflix Subscription",
    10: "Uber Rides",
}

# The two recommendation types, their titles, descriptions and priorities.
SUBSCRIPTION_TYPE = "Subscription Optimization"
SUBSCRIPTION_TITLE = "Review %d Subscription Services"
SUBSCRIPTION_TEXT = "You spend ~$%.2f/month on subscriptions. Consider reviewing for unused services."
LOYALTY_TYPE = "Loyalty Programs"
LOYALTY_TITLE = "Join loyalty programs at top %d merchants"
LOYALTY_TEXT = "Potential to earn $%.2f in rewards/cashback"
PRIORITY_HIGH, PRIORITY_MEDIUM = "High", "Medium"

SUBSCRIPTION_MIN_CONSISTENCY = 0.8
SUBSCRIPTION_MIN_FREQUENCY = 0.8
SUBSCRIPTION_MIN_COUNT = 2
HIGH_COST_SUBSCRIPTION = 20.0
LOYALTY_QUANTILE = 0.7
LOYALTY_REWARD_RATE = 0.02
SUBSCRIPTION_SAVING_RATE = 0.2


def merchant_name(merchant_id: Column, category: Column) -> Column:
    """Fixed name for ids 1–10, else ``{category} Merchant {id}``."""
    names = F.create_map(*[x for k, v in MERCHANT_NAMES.items()
                           for x in (F.lit(k).cast("long"), F.lit(v))])
    return F.coalesce(F.try_element_at(names, merchant_id),
                      F.concat(category, F.lit(" Merchant "), merchant_id.cast("string")))


def _frequency_score(count: str, days: int) -> Column:
    """Transactions in 30 days (2 dp)."""
    return round_dec(F.col(count) / F.lit(float(days)) * 30, 2).alias("frequency_score")


def merchant_stats(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """M1–M3 (+ J2, C15): per client × merchant spend statistics, MCC of the
    earliest transaction (nulls skipped), category, consistency and frequency
    scores and display name."""
    return ledger.memo(("merchant_stats", period_days(period)),
                       lambda: _merchant_stats(ledger, period))


def _merchant_stats(ledger: Ledger, period: str) -> DataFrame:
    days = period_days(period)
    tx = relative_period(ledger, period, rule="all").filter(F.col("merchant_id").isNotNull())
    first_key = F.when(F.col("mcc").isNotNull(), F.struct("date", "id", "mcc"))
    g = tx.groupBy("client_id", "merchant_id").agg(
        money_sum_dec("amount").alias("_d"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.stddev_samp("amount").alias("_std"),
        F.min("date").alias("first_transaction"),
        F.max("date").alias("last_transaction"),
        F.min_by("mcc", first_key).alias("mcc"))
    g = g.select(
        "client_id", "merchant_id",
        F.col("_d").cast("double").alias("total_spent"), "transaction_count",
        round_dec(F.col("_d").cast("double") / F.col("transaction_count"), 2).alias("avg_amount"),
        F.coalesce(round_dec("_std", 2), F.lit(0.0)).alias("std_amount"),
        "first_transaction", "last_transaction", "mcc")
    g = with_category(g, ledger.mcc_codes)
    cv = F.when(F.col("avg_amount") > 0, F.col("std_amount") / F.col("avg_amount")).otherwise(0.0)
    return g.select(
        "*",
        round_dec(F.lit(1.0) / (F.lit(1.0) + cv), 3).alias("consistency_score"),
        _frequency_score("transaction_count", days),
        merchant_name(F.col("merchant_id"), F.col("category")).alias("merchant_name"))


_THRESHOLDS = {"total_spent": "spending_threshold", "frequency_score": "frequency_threshold"}


def client_merchant_totals(ledger: Ledger, period: str = "3_months", approx: bool = False,
                           stats: DataFrame | None = None) -> DataFrame:
    """Per client over its merchants, shared by M4, M7 and M10: number of
    merchants, exact total spend and the 70th percentiles of spend and frequency
    (linear interpolation, by histogram, so a client's merchants never meet in
    one buffer; ``approx=True`` takes sketches)."""
    def build(s: DataFrame) -> DataFrame:
        totals = [F.count(F.lit(1)).alias("total_merchants"), F.sum(money("total_spent")).alias("_t")]
        if approx:
            return s.groupBy("client_id").agg(
                *totals, *[F.percentile_approx(c, LOYALTY_QUANTILE, 10000).cast("double").alias(name)
                           for c, name in _THRESHOLDS.items()])
        marks = exact_percentiles(s.select("client_id", *_THRESHOLDS), ["client_id"], _THRESHOLDS, LOYALTY_QUANTILE)
        return attach_per_client(ledger, s.groupBy("client_id").agg(*totals), marks, "left")

    if stats is not None:
        return build(stats)
    return ledger.memo(("merchant_client_totals", period_days(period), approx),
                       lambda: build(merchant_stats(ledger, period)))


def _top_sums(s: DataFrame) -> DataFrame:
    """Spend ``_t3``, ``_t5``, ``_t10`` of a client's top merchants.  The salt
    reads the same merchant columns as the other per-client branches (spend and
    count), so all of them prune the merchant aggregation alike and Spark
    reuses one stage for it."""
    top = top_k_per_group(s, ["client_id"], [F.col("total_spent").desc(), F.col("merchant_id")],
                          10, salt_cols=["merchant_id", "transaction_count"])
    return top.groupBy("client_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("_d"))).alias(f"_t{k}") for k in (3, 5, 10)])


def _share(part: str) -> Column:
    """Percent of the client's total ``_t`` (1 dp)."""
    return round_dec(F.col(part).cast("double") / F.col("_t").cast("double") * 100, 1)


def concentration(ledger: Ledger, period: str = "3_months",
                  stats: DataFrame | None = None) -> DataFrame:
    """M4: share of the top 3 / 5 / 10 merchants in the client's total (1 dp);
    clients whose total is 0 have no row."""
    s = merchant_stats(ledger, period) if stats is None else stats
    totals = s.groupBy("client_id").agg(F.count(F.lit(1)).alias("total_merchants"),
                                        F.sum(money("total_spent")).alias("_t"))
    s = s.select("client_id", "merchant_id", "total_spent", "transaction_count",
                 money("total_spent").alias("_d"))
    tops = _top_sums(s)
    df = attach_per_client(ledger, totals, tops).filter(F.col("_t") != 0)
    return df.select(
        "client_id", "total_merchants",
        *[_share(f"_t{k}").alias(f"top_{k}_percentage") for k in (3, 5, 10)])


def subscriptions(ledger: Ledger, period: str = "3_months",
                  stats: DataFrame | None = None) -> DataFrame:
    """M5 + M6: regular merchants (consistency > 0.8, frequency >= 0.8, at
    least two purchases) with their estimated monthly cost, plus per-client
    totals.  A one-month period is too short: the result is empty."""
    s = merchant_stats(ledger, period) if stats is None else stats
    subs = s.filter((F.col("consistency_score") > SUBSCRIPTION_MIN_CONSISTENCY)
                    & (F.col("frequency_score") >= SUBSCRIPTION_MIN_FREQUENCY)
                    & (F.col("transaction_count") >= SUBSCRIPTION_MIN_COUNT))
    if period_days(period) <= 30:
        subs = subs.filter(F.lit(False))
    subs = subs.withColumn("estimated_monthly_cost", round_dec(
        F.col("total_spent") / F.col("transaction_count"), 2))
    # Per-client totals by aggregation + join (not a window over all of a
    # client's merchants, which would put a hot client in one task).
    totals = subs.groupBy("client_id").agg(
        F.sum(money("estimated_monthly_cost")).cast("double")
        .alias("total_monthly_subscriptions"),
        F.count(F.lit(1)).alias("subscription_count"),
        F.count_if(F.col("estimated_monthly_cost") > HIGH_COST_SUBSCRIPTION)
        .alias("high_cost_count"))
    return attach_per_client(ledger, subs, totals)


def loyalty_candidates(ledger: Ledger, period: str = "3_months", approx: bool = False,
                       stats: DataFrame | None = None) -> DataFrame:
    """M7 + M8: merchants at or above the client's 70th percentile of spend or
    of frequency (see :func:`client_merchant_totals`), scored
    0.6·spend + 20·frequency + 2·count."""
    s = merchant_stats(ledger, period) if stats is None else stats
    if approx:
        th = client_merchant_totals(ledger, period, True, stats).select("client_id", *_THRESHOLDS.values())
    else:
        th = exact_percentiles(s.select("client_id", *_THRESHOLDS), ["client_id"], _THRESHOLDS, LOYALTY_QUANTILE)
    c = attach_per_client(ledger, s, th).filter(
        (F.col("total_spent") >= F.col("spending_threshold"))
        | (F.col("frequency_score") >= F.col("frequency_threshold")))
    score = (F.col("total_spent") * 0.6 + F.col("frequency_score") * 20
             + F.col("transaction_count") * 2)
    return c.select(
        *[round_dec(x, 6).alias(x) if x in ("spending_threshold", "frequency_threshold")
          else F.col(x) for x in c.columns],
        round_dec(score, 2).alias("loyalty_score"),
        (F.col("total_spent") * LOYALTY_REWARD_RATE).alias("potential_rewards"))


def spending_volatility(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """M9: statistics of the client's daily purchase totals; all 0 with fewer
    than two days."""
    tx = relative_period(ledger, period, rule="all")
    daily = tx.groupBy("client_id", F.to_date("date").alias("day")).agg(
        money_sum_dec("amount").alias("_d"))
    return _volatility(daily)


def _volatility(daily: DataFrame) -> DataFrame:
    v = daily.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("active_days"),
        F.sum("_d").alias("_t"),
        F.stddev_samp(F.col("_d").cast("double")).alias("_std"),
        F.max("_d").alias("_max"), F.min("_d").alias("_min"))
    mean = F.col("_t").cast("double") / F.col("active_days")
    ok = F.col("active_days") >= 2

    def z(c: Column) -> Column:
        return F.when(ok, c).otherwise(F.lit(0.0))

    return v.select(
        "client_id", "active_days",
        z(round_dec(mean, 2)).alias("avg_daily_spending"),
        z(round_dec("_std", 2)).alias("std_daily_spending"),
        z(F.col("_max").cast("double")).alias("max_daily_spending"),
        z(F.col("_min").cast("double")).alias("min_daily_spending"),
        z(F.when(mean > 0, round_dec(F.col("_std") / mean, 3)).otherwise(F.lit(0.0)))
        .alias("volatility_coefficient"))


def _merchant_and_day_sums(ledger: Ledger, period: str) -> tuple[DataFrame, DataFrame]:
    """Spend and count per client × merchant, and spend per client × day, from
    one aggregation: a transaction counts for its merchant and for its day.
    ``kind`` is an aggregate, so no filter on it moves below the exchange, and
    both tables read every aggregate: all branches over them then share one
    scan and one exchange."""
    tx = relative_period(ledger, period, rule="all")
    merchant, day = F.col("merchant_id"), F.to_date("date")
    parts = F.array(
        F.struct(merchant, F.lit(None).cast("date").alias("day"),
                 F.when(merchant.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("kind")),
        F.struct(F.lit(None).cast(tx.schema["merchant_id"].dataType).alias("merchant_id"), day.alias("day"),
                 F.lit(2).alias("kind")))
    sums = (tx.select("client_id", "amount", F.inline(parts)).groupBy("client_id", "merchant_id", "day")
            .agg(money_sum_dec("amount").alias("_d"), F.count(F.lit(1)).alias("transaction_count"),
                 F.max("kind").alias("_kind"))
            .filter(F.col("transaction_count") > 0))
    merchants = sums.filter(F.col("_kind") == 1).select(
        "client_id", "merchant_id", "_d", F.col("_d").cast("double").alias("total_spent"), "transaction_count",
        _frequency_score("transaction_count", period_days(period)))
    return merchants, sums.filter(F.col("_kind") == 2).select("client_id", "day", "_d")


def merchant_summary(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """One row per client — merchant count, concentration, volatility and
    number of loyalty candidates, from one pass over the transactions."""
    merchants, days = _merchant_and_day_sums(ledger, period)
    tops = _top_sums(merchants)
    marks = exact_percentiles(merchants.select("client_id", *_THRESHOLDS), ["client_id"], _THRESHOLDS, LOYALTY_QUANTILE)
    base = attach_per_client(ledger, merchants, marks, "left").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("total_merchants"), F.sum("_d").alias("_t"),
        F.count_if((F.col("total_spent") >= F.col("spending_threshold"))
                   | (F.col("frequency_score") >= F.col("frequency_threshold"))).alias("loyalty_candidates"))
    df = attach_per_client(ledger, base, tops, "left")
    df = attach_per_client(ledger, df, _volatility(days), "left")
    return df.select(
        "client_id", "total_merchants",
        *[F.when(F.col("_t") != 0, _share(f"_t{k}")).otherwise(F.lit(0.0)).alias(f"top_{k}_percentage") for k in (3, 5, 10)],
        "avg_daily_spending", "std_daily_spending", "max_daily_spending", "min_daily_spending",
        "volatility_coefficient", "loyalty_candidates")


def merchant_recommendations(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """Up to two recommendation rows per client — review subscriptions
    (20 % assumed saving, High above 100/month) and join the loyalty programmes
    of the three best-scored merchants (2 % of their spend)."""
    subs = subscriptions(ledger, period).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(money("estimated_monthly_cost")).alias("_c"))
    cost = F.col("_c").cast("double")
    sub_rows = subs.select(
        "client_id", F.lit(1).cast("long").alias("seq"),
        F.lit(SUBSCRIPTION_TYPE).alias("type"),
        F.format_string(SUBSCRIPTION_TITLE, "_n").alias("title"),
        F.format_string(SUBSCRIPTION_TEXT, round_dec(cost, 2)).alias("description"),
        F.when(cost > 100, PRIORITY_HIGH).otherwise(PRIORITY_MEDIUM).alias("priority"),
        (cost * SUBSCRIPTION_SAVING_RATE).alias("potential_value"),
        F.lit("").alias("merchants"))
    loy = loyalty_candidates(ledger, period)
    top = top_k_per_group(loy, ["client_id"], [F.col("loyalty_score").desc(),
                                               F.col("merchant_id")], 3,
                          salt_cols=["merchant_id"])
    names = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "merchant_name"))), lambda x: x["merchant_name"]), ", ")
    reward = F.col("_t").cast("double") * LOYALTY_REWARD_RATE
    loy_rows = top.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(money("total_spent")).alias("_t"),
        names.alias("merchants")).select(
        "client_id", F.lit(2).cast("long").alias("seq"), F.lit(LOYALTY_TYPE).alias("type"),
        F.format_string(LOYALTY_TITLE, "_n").alias("title"),
        F.format_string(LOYALTY_TEXT, round_dec(reward, 2)).alias("description"),
        F.lit(PRIORITY_MEDIUM).alias("priority"),
        reward.alias("potential_value"), "merchants")
    return sub_rows.unionByName(loy_rows)


def display_labels(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """C13 + C15–C18: display strings of the merchant table — name, truncated
    name and category, money and percent texts, signed difference to the
    client's average merchant."""
    s = merchant_stats(ledger, period)
    per_client = s.groupBy("client_id").agg(
        F.sum(money("total_spent")).cast("double").alias("_tot"),
        F.count(F.lit(1)).alias("_nm"))
    s = attach_per_client(ledger, s, per_client)
    tot = F.col("_tot")
    mean = tot / F.col("_nm")
    share = F.when(tot > 0, F.col("total_spent") / tot * 100).otherwise(F.lit(0.0))
    vs = F.when(mean > 0, (F.col("total_spent") - mean) / mean * 100).otherwise(F.lit(0.0))
    return s.select(
        "client_id", "merchant_id", "merchant_name",
        truncate_label("merchant_name", 20).alias("short_name"),
        truncate_label("category", 25).alias("category_label"),
        round_dec("total_spent", 1).alias("total_1dp"),
        money_text("total_spent").alias("total_text"),
        money_text("avg_amount").alias("avg_text"),
        pct_text(share).alias("share_text"),
        pct_text(vs, signed=True).alias("vs_average_text"))
