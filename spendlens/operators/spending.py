"""Spending analysis (B1–B15), for all clients at once.

The period filter is F3 (anchor = latest transaction of the client, refunds
included) unless a custom range is given (F4); only purchases are kept (F2).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.categories import with_category
from spendlens.functions.cleaning import day_name, month_key
from spendlens.functions.exprs import (cents, cents_to_double, money_sum, money_sum_dec,
                                       pct_change, round_dec, safe_div)
from spendlens.functions.periods import (custom_range, days_before, period_days, relative_period,
                                         since, spend_only)
from spendlens.plans.joins import attach_per_client, rank_all, top_k_per_group
from spendlens.sources.schema import Ledger


def filtered_transactions(ledger: Ledger, period: str = "3_months", start: str | None = None,
                          end: str | None = None) -> DataFrame:
    """B1: F1 + F3/F4 + F2 for every client."""
    if start and end:
        return custom_range(ledger, start, end)
    return relative_period(ledger, period, rule="all").drop("anchor")


def category_breakdown(ledger: Ledger, period: str = "3_months", start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """B2: per client × category — total, count, mean (2 dp) and share of the
    client's total (1 dp, computed from the rounded totals)."""
    tx = with_category(filtered_transactions(ledger, period, start, end), ledger.mcc_codes)
    g = tx.groupBy("client_id", "category").agg(
        money_sum_dec("amount").alias("_sum"), F.count(F.lit(1)).alias("transaction_count"))
    tot = F.sum("_sum").over(Window.partitionBy("client_id")).cast("double")
    total = F.col("_sum").cast("double")
    return g.select(
        "client_id", "category",
        total.alias("total_spent"),
        "transaction_count",
        round_dec(total / F.col("transaction_count"), 2).alias("avg_transaction"),
        F.when(tot > 0, round_dec(total / tot * 100, 1)).otherwise(F.lit(0.0)).alias("percentage"),
    )


def top_categories(ledger: Ledger, period: str = "3_months", n: int = 10) -> DataFrame:
    """The ``n`` largest categories per client, with a top-5 flag."""
    b = category_breakdown(ledger, period)
    r = rank_all(b, ["client_id"], [F.col("total_spent").desc(), F.col("category")])
    return r.filter(F.col("rank") <= n).withColumn("in_top5", F.col("rank") <= 5)


def top_merchants(ledger: Ledger, period: str = "3_months", top_n: int = 10,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """B3 + B13: the ``top_n`` merchants per client by spend, plus the headline
    figures computed over that listed top: top-3 share and the most frequent
    merchant (first in list order among equal counts).  Rows without a
    merchant id form no group."""
    tx = filtered_transactions(ledger, period, start, end).filter(
        F.col("merchant_id").isNotNull())
    g = tx.groupBy("client_id", "merchant_id").agg(
        money_sum_dec("amount").alias("_sum"), F.count(F.lit(1)).alias("transaction_count"),
        F.min("date").alias("first_transaction"), F.max("date").alias("last_transaction"))
    g = g.select(
        "client_id", "merchant_id",
        F.col("_sum").cast("double").alias("total_spent"), "transaction_count",
        round_dec(F.col("_sum").cast("double") / F.col("transaction_count"), 2)
        .alias("avg_transaction"),
        "first_transaction", "last_transaction",
        F.concat(F.lit("Merchant "), F.col("merchant_id").cast("string")).alias("merchant_name"),
        F.col("_sum").alias("_dec"))
    top = top_k_per_group(g, ["client_id"], [F.col("total_spent").desc(), F.col("merchant_id")],
                          top_n, salt_cols=["merchant_id"])
    w = Window.partitionBy("client_id")
    listed = F.sum("_dec").over(w)
    top3 = F.sum(F.when(F.col("rank") <= 3, F.col("_dec"))).over(w)
    freq = F.min_by(F.col("merchant_name"),
                    F.struct(-F.col("transaction_count"), F.col("rank"))).over(w)
    return (top.withColumn("top3_share",
                           F.when(listed > 0, round_dec(top3.cast("double") / listed.cast("double")
                                                        * 100, 1)).otherwise(F.lit(0.0)))
               .withColumn("most_frequent_merchant", freq)
               .drop("_dec"))


def spending_trends(ledger: Ledger, period: str = "1_year") -> DataFrame:
    """B4 + B5 + B6: spend per month × category and the month totals in one
    grouping-sets pass; ``category_rank`` orders categories by their spend
    over the whole window (1 = largest, 0 on month-total rows)."""
    tx = with_category(filtered_transactions(ledger, period), ledger.mcc_codes)
    tx = tx.select("client_id", "category", month_key("date").alias("month_year"), "amount")
    g = (tx.groupingSets([["client_id", "month_year", "category"], ["client_id", "month_year"]],
                         "client_id", "month_year", "category")
           .agg(money_sum_dec("amount").alias("_sum"),
                F.grouping_id().alias("_gid")))
    is_total = F.col("_gid") != 0
    cat_total = F.sum(F.when(~is_total, F.col("_sum"))).over(
        Window.partitionBy("client_id", "category"))
    g = g.withColumn("_cat_total", cat_total)
    rank = F.dense_rank().over(Window.partitionBy("client_id", "_is_total").orderBy(
        F.col("_cat_total").desc(), F.col("category")))
    return (g.withColumn("_is_total", is_total)
             .withColumn("category_rank",
                         F.when(~F.col("_is_total"), rank.cast("long")).otherwise(F.lit(0).cast("long")))
             .select("client_id", "month_year",
                     F.when(~F.col("_is_total"), F.col("category")).alias("category"),
                     F.col("_sum").cast("double").alias("amount"),
                     F.col("_is_total").alias("is_total"), "category_rank"))


def monthly_totals(ledger: Ledger, period: str = "1_year") -> DataFrame:
    """B5 alone: spend per client × month."""
    tx = filtered_transactions(ledger, period)
    return (tx.groupBy("client_id", month_key("date").alias("month_year"))
              .agg(money_sum("amount").alias("amount")))


def spending_patterns(ledger: Ledger, period: str = "3_months", start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """B7 + B15: spend by day of week, hour and day of month, and the overall
    count / mean / max / min, in one grouping-sets pass.  ``sort_key`` is the
    calendar order of the bucket (Monday = 0)."""
    tx = filtered_transactions(ledger, period, start, end).select(
        "client_id", "amount",
        day_name("date").alias("day_of_week"),
        F.weekday("date").cast("long").alias("dow_index"),
        F.hour("date").cast("long").alias("hour"),
        F.dayofmonth("date").cast("long").alias("day_of_month"))
    g = (tx.groupingSets(
            [["client_id", "day_of_week", "dow_index"], ["client_id", "hour"],
             ["client_id", "day_of_month"], ["client_id"]],
            "client_id", "day_of_week", "dow_index", "hour", "day_of_month")
           .agg(money_sum_dec("amount").alias("_sum"), F.count(F.lit(1)).alias("transactions"),
                F.max("amount").alias("max_transaction"), F.min("amount").alias("min_transaction"),
                (F.grouping("day_of_week") * 4 + F.grouping("hour") * 2
                 + F.grouping("day_of_month")).alias("_gid")))
    gid = F.col("_gid")
    # grouping_id bits: day_of_week=4, hour=2, day_of_month=1 (1 = rolled up).
    dim = (F.when(gid == 3, "day_of_week").when(gid == 5, "hour")
             .when(gid == 6, "day_of_month").otherwise("all"))
    bucket = (F.when(gid == 3, F.col("day_of_week")).when(gid == 5, F.col("hour").cast("string"))
                .when(gid == 6, F.col("day_of_month").cast("string")).otherwise(F.lit("all")))
    key = (F.when(gid == 3, F.col("dow_index")).when(gid == 5, F.col("hour"))
             .when(gid == 6, F.col("day_of_month")).otherwise(F.lit(0).cast("long")))
    total = F.col("_sum").cast("double")
    return g.select("client_id", dim.alias("dimension"), bucket.alias("bucket"),
                    key.alias("sort_key"), total.alias("amount"), "transactions",
                    (total / F.col("transactions")).alias("avg_transaction"),
                    "max_transaction", "min_transaction")


def comparison_windows(start: str, end: str) -> tuple[dt.datetime, dt.datetime, dt.datetime]:
    """B8 with a range: the window ``[start, end]`` and the one of the same
    length right before it, as ``(previous start, start, end)``."""
    lo, hi = (dt.datetime.fromisoformat(x) for x in (start, end))
    if hi < lo:
        raise ValueError(f"the range ends before it starts: {start} to {end}")
    return lo - (hi - lo), lo, hi


def comparison_metrics(ledger: Ledger, period: str = "3_months", start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """Current vs previous period (anchor after F2, F6), the change
    percentages, spending velocity over the real period length and the number
    of categories in the period's breakdown.  With ``start`` and ``end`` the
    current period is that range (F4) and the previous one, of the same length,
    ends where it starts.  Clients with no purchase in the period have no row.

    One pass: purchases are folded per client × mcc, which carries the sums of
    both periods, and then per client with the mccs of the breakdown."""
    if start and end:
        before, lo, hi = comparison_windows(start, end)
        days = max(1.0, (hi - lo).total_seconds() / 86_400)
        at = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
        df = custom_range(ledger, before.isoformat(sep=" "), hi.isoformat(sep=" "))
        cur, prev = F.col("date") >= at(lo), F.col("date") < at(lo)
        listed = cur
    else:
        days = float(period_days(period))
        both = ledger.client_activity().select("client_id", "last_date", F.col("last_purchase").alias("anchor"))
        tx = since(ledger, 2 * int(days), "spend").select("client_id", "mcc", "amount", "date")
        df = attach_per_client(ledger, spend_only(tx), both).where(F.col("date") >= days_before("anchor", 2 * int(days)))
        cur = F.col("date") >= days_before("anchor", int(days))
        prev = ~cur
        listed = F.col("date") >= days_before("last_date", int(days))
    m = df.groupBy("client_id", "mcc").agg(
        F.sum(F.when(cur, cents("amount"))).alias("_cs"), F.count_if(cur).alias("_cn"),
        F.sum(F.when(prev, cents("amount"))).alias("_ps"), F.count_if(prev).alias("_pn"),
        F.count_if(listed).alias("_bn"))
    m = m.groupBy("client_id").agg(
        F.sum("_cs").alias("_cs"), F.sum("_cn").alias("current_transactions"),
        F.sum("_ps").alias("_ps"), F.sum("_pn").alias("previous_transactions"),
        F.collect_set(F.when(F.col("_bn") > 0, F.struct("mcc"))).alias("_mccs"))  # codes, not rows
    sums = ["_cs", "current_transactions", "_ps", "previous_transactions"]
    m = with_category(m.select("client_id", *sums, F.inline("_mccs")), ledger.mcc_codes)
    m = m.groupBy("client_id", *sums).agg(F.countDistinct("category").alias("category_diversity"))
    cs = F.coalesce(cents_to_double("_cs"), F.lit(0.0))
    ps = F.coalesce(cents_to_double("_ps"), F.lit(0.0))
    m = m.select(
        "client_id", cs.alias("current_spending"), ps.alias("previous_spending"),
        "current_transactions", "previous_transactions", "category_diversity")
    m = m.select(
        "*",
        pct_change("current_spending", "previous_spending").alias("spending_change_pct"),
        pct_change(F.col("current_transactions").cast("double"),
                   F.col("previous_transactions").cast("double")).alias("transaction_change_pct"),
        safe_div("current_spending", "current_transactions").alias("avg_transaction_current"),
        safe_div("previous_spending", "previous_transactions").alias("avg_transaction_previous"),
        (F.col("current_transactions") / F.lit(days)).alias("velocity_per_day"))
    return m.withColumn("avg_transaction_change_pct",
                        pct_change("avg_transaction_current", "avg_transaction_previous"))


def category_insights(ledger: Ledger, period: str = "3_months",
                      approx: bool = False) -> DataFrame:
    """B12 + F13: per client × category, whether the category's mean is above
    the mean of the client's category means, whether its share exceeds 20 %,
    and whether its count exceeds the 75th percentile of counts (exact, with
    linear interpolation; ``approx=True`` uses ``percentile_approx``)."""
    b = category_breakdown(ledger, period)
    w = Window.partitionBy("client_id")
    avg_dec = F.col("avg_transaction").cast("decimal(18,2)")
    n = F.count(F.lit(1)).over(w)
    if approx:
        p75 = F.percentile_approx("transaction_count", 0.75, 10000).over(w).cast("double")
    else:
        p75 = F.percentile(F.col("transaction_count"), F.lit(0.75)).over(w)
    return b.select(
        "*",
        (avg_dec * n > F.sum(avg_dec).over(w)).alias("above_average"),
        (F.col("percentage") > 20).alias("significant_share"),
        p75.alias("count_p75"),
    ).withColumn("frequent", F.col("transaction_count") > F.col("count_p75"))
