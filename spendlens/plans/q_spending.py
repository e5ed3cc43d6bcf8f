"""Registered spending queries (B1–B15, F3, F4, F6, F13) and their oracles."""

from __future__ import annotations

from dataclasses import replace

from spendlens.functions.categories import FALLBACK_MAPS
from spendlens.operators import spending as sp
from spendlens.plans.registry import register
from spendlens.plans.sqlkit import (DB, MSD, PCT, R, SDIV, anchor_cte, categorized_cte,
                                    period_cte, q, with_ledger)

CUSTOM_START, CUSTOM_END = "2000-01-01", "2000-06-30"
#: Days of that range; the range before it, of the same length, begins 1999-07-04.
RANGE_DAYS, RANGE_BEFORE = 181.0, "1999-07-04"


def breakdown_sql(days: int | None = None, start: str | None = None, end: str | None = None,
                   name: str = "b") -> list[str]:
    if start:
        f = (f"f AS (SELECT * FROM tx WHERE date >= TIMESTAMP '{start}' "
             f"AND date <= TIMESTAMP '{end}' AND amount > 0)")
    else:
        f = period_cte(days)
    return [
        f, categorized_cte("f", "fc"),
        f"g AS (SELECT client_id, category, {MSD('amount')} AS s, COUNT(*) AS transaction_count "
        "FROM fc GROUP BY client_id, category)",
        f"{name} AS (SELECT client_id, category, CAST(s AS DOUBLE) AS total_spent, transaction_count, "
        f"{R('CAST(s AS DOUBLE) / transaction_count', 2)} AS avg_transaction, "
        "CASE WHEN SUM(s) OVER (PARTITION BY client_id) > 0 THEN "
        f"{R('CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY client_id) AS DOUBLE) * 100', 1)}"
        " ELSE 0.0 END AS percentage FROM g)",
    ]


@register("category_breakdown", "N", "B2",
          with_ledger("N", *breakdown_sql(90)) + "SELECT * FROM b")
def category_breakdown(led):
    return sp.category_breakdown(led, "3_months")


def _fallback_categories(which: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in FALLBACK_MAPS[which].items())
    return f"fallback AS (SELECT mcc, CASE mcc {cases} ELSE 'Other' END AS category FROM (SELECT DISTINCT mcc FROM tx))"


@register("category_breakdown_no_mcc", "N", "C14, B2",
          with_ledger("N", _fallback_categories("spending"), *breakdown_sql(90))
          .replace("LEFT JOIN mcc m", "LEFT JOIN fallback m") + "SELECT * FROM b")
def category_breakdown_no_mcc(led):
    return sp.category_breakdown(replace(led, mcc_codes=None, _memo={}), "3_months")


@register("custom_range_breakdown", "N", "F4, B2",
          with_ledger("N", *breakdown_sql(start=CUSTOM_START, end=CUSTOM_END))
          + "SELECT * FROM b")
def custom_range_breakdown(led):
    return sp.category_breakdown(led, start=CUSTOM_START, end=CUSTOM_END)


@register("relative_period_spend", "N", "B1, F2, F3, F8",
          with_ledger("N", period_cte(180))
          + "SELECT client_id, id, merchant_id, mcc, date, amount FROM f", ts=("date",))
def relative_period_spend(led):
    return sp.filtered_transactions(led, "6_months").select(
        "client_id", "id", "merchant_id", "mcc", "date", "amount")


@register("top_categories", "N", "B14",
          with_ledger("N", *breakdown_sql(90))
          + "SELECT *, rank <= 5 AS in_top5 FROM (SELECT *, CAST(row_number() OVER ("
            "PARTITION BY client_id ORDER BY total_spent DESC, category) AS BIGINT) AS rank "
            "FROM b) WHERE rank <= 10")
def top_categories(led):
    return sp.top_categories(led, "3_months", 10)


_TOP3_SHARE = ("CAST(SUM(CASE WHEN rank <= 3 THEN d END) OVER w AS DOUBLE) "
               "/ CAST(SUM(d) OVER w AS DOUBLE) * 100")


def _top_merchants_sql(days: int, n: int) -> str:
    return with_ledger(
        "N", period_cte(days),
        f"g AS (SELECT client_id, merchant_id, {MSD('amount')} AS d, COUNT(*) AS transaction_count, "
        "min(date) AS first_transaction, max(date) AS last_transaction FROM f "
        "WHERE merchant_id IS NOT NULL GROUP BY client_id, merchant_id)",
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY d DESC, "
        "merchant_id) AS BIGINT) AS rank FROM g)",
        f"t AS (SELECT * FROM r WHERE rank <= {n})",
    ) + (
        "SELECT client_id, merchant_id, CAST(d AS DOUBLE) AS total_spent, transaction_count, "
        f"{R('CAST(d AS DOUBLE) / transaction_count', 2)} AS avg_transaction, first_transaction, "
        "last_transaction, 'Merchant ' || CAST(merchant_id AS VARCHAR) AS merchant_name, rank, "
        "CASE WHEN SUM(d) OVER w > 0 THEN "
        f"{R(_TOP3_SHARE, 1)}"
        " ELSE 0.0 END AS top3_share, "
        "arg_min('Merchant ' || CAST(merchant_id AS VARCHAR), "
        "struct_pack(a := -transaction_count, b := rank)) OVER w AS most_frequent_merchant "
        "FROM t WINDOW w AS (PARTITION BY client_id)")


@register("top_merchants", "N", "B3, B13", _top_merchants_sql(90, 10),
          ts=("first_transaction", "last_transaction"))
def top_merchants(led):
    return sp.top_merchants(led, "3_months", 10)


_TRENDS_SQL = with_ledger(
    "N", period_cte(365), categorized_cte("f", "fc"),
    f"g AS (SELECT client_id, strftime(date, '%Y-%m') AS month_year, category, "
    f"{MSD('amount')} AS s, GROUPING(category) AS gid FROM fc "
    "GROUP BY GROUPING SETS ((client_id, month_year, category), (client_id, month_year)))",
    "c AS (SELECT *, SUM(CASE WHEN gid = 0 THEN s END) OVER (PARTITION BY client_id, category)"
    " AS ct FROM g)",
) + (
    "SELECT client_id, month_year, CASE WHEN gid = 0 THEN category END AS category, "
    "CAST(s AS DOUBLE) AS amount, gid <> 0 AS is_total, "
    "CASE WHEN gid = 0 THEN CAST(dense_rank() OVER (PARTITION BY client_id, gid <> 0 "
    "ORDER BY ct DESC, category) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS category_rank FROM c")


@register("spending_trends", "N", "B4, B5, B6", _TRENDS_SQL)
def spending_trends(led):
    return sp.spending_trends(led, "1_year")


_PATTERNS_SQL = with_ledger(
    "E", period_cte(90),
    "p AS (SELECT client_id, amount, dayname(date) AS day_of_week, "
    "CAST(isodow(date) - 1 AS BIGINT) AS dow_index, CAST(hour(date) AS BIGINT) AS hour, "
    "CAST(day(date) AS BIGINT) AS day_of_month FROM f)",
    f"g AS (SELECT client_id, day_of_week, dow_index, hour, day_of_month, {MSD('amount')} AS s, "
    "COUNT(*) AS transactions, max(amount) AS max_transaction, min(amount) AS min_transaction, "
    "GROUPING(day_of_week, hour, day_of_month) AS gid FROM p GROUP BY GROUPING SETS "
    "((client_id, day_of_week, dow_index), (client_id, hour), (client_id, day_of_month), "
    "(client_id)))",
) + (
    "SELECT client_id, CASE gid WHEN 3 THEN 'day_of_week' WHEN 5 THEN 'hour' "
    "WHEN 6 THEN 'day_of_month' ELSE 'all' END AS dimension, "
    "CASE gid WHEN 3 THEN day_of_week WHEN 5 THEN CAST(hour AS VARCHAR) "
    "WHEN 6 THEN CAST(day_of_month AS VARCHAR) ELSE 'all' END AS bucket, "
    "CASE gid WHEN 3 THEN dow_index WHEN 5 THEN hour WHEN 6 THEN day_of_month "
    "ELSE CAST(0 AS BIGINT) END AS sort_key, CAST(s AS DOUBLE) AS amount, transactions, "
    "CAST(s AS DOUBLE) / transactions AS avg_transaction, max_transaction, min_transaction FROM g")


@register("spending_patterns", "E", "B7, B15", _PATTERNS_SQL)
def spending_patterns(led):
    return sp.spending_patterns(led, "3_months")


def _comparison_sql(days: int | None = None, bounds: tuple[str, str, str] | None = None) -> str:
    if bounds:
        before, lo, hi = (f"TIMESTAMP '{x}'" for x in bounds)
        src = (f"s AS (SELECT * FROM tx WHERE amount > 0 AND date >= {before} AND date <= {hi})",)
        cur, prev = f"date >= {lo}", f"date < {lo}"
        listed = breakdown_sql(start=bounds[1], end=bounds[2])
    else:
        src = (anchor_cte("a0", "spend"),
               "s AS (SELECT t.*, a.anchor FROM tx t JOIN a0 a ON t.client_id = a.client_id WHERE t.amount > 0)")
        cur = f"date >= {DB('anchor', days)}"
        prev = f"(date >= {DB('anchor', 2 * days)} AND date < {DB('anchor', days)})"
        listed = breakdown_sql(days)
    return with_ledger(
        "N", *src,
        f"m0 AS (SELECT client_id, "
        f"CAST(COALESCE(SUM(CASE WHEN {cur} THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS current_spending, "
        f"CAST(COALESCE(SUM(CASE WHEN {prev} THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS previous_spending, "
        f"COUNT(*) FILTER (WHERE {cur}) AS current_transactions, COUNT(*) FILTER (WHERE {prev}) AS previous_transactions "
        "FROM s GROUP BY client_id)",
        "m1 AS (SELECT *, "
        f"{PCT('current_spending', 'previous_spending')} AS spending_change_pct, "
        f"{PCT('CAST(current_transactions AS DOUBLE)', 'CAST(previous_transactions AS DOUBLE)')}"
        " AS transaction_change_pct, "
        f"{SDIV('current_spending', 'current_transactions')} AS avg_transaction_current, "
        f"{SDIV('previous_spending', 'previous_transactions')} AS avg_transaction_previous, "
        f"current_transactions / {float(days) if days else RANGE_DAYS} AS velocity_per_day FROM m0)",
        *listed,
        "dv AS (SELECT client_id, COUNT(*) AS category_diversity FROM b GROUP BY client_id)",
    ) + (
        "SELECT m1.*, "
        f"{PCT('avg_transaction_current', 'avg_transaction_previous')} AS avg_transaction_change_pct, "
        "dv.category_diversity FROM m1 JOIN dv ON m1.client_id = dv.client_id")


@register("comparison_metrics", "N", "B8, B9, B10, B11, F6", _comparison_sql(90))
def comparison_metrics(led):
    return sp.comparison_metrics(led, "3_months")


@register("comparison_metrics_range", "N", "B8 (explicit range, Q8), F4",
          _comparison_sql(bounds=(RANGE_BEFORE, CUSTOM_START, CUSTOM_END)))
def comparison_metrics_range(led):
    return sp.comparison_metrics(led, start=CUSTOM_START, end=CUSTOM_END)


_INSIGHTS_SQL = with_ledger("N", *breakdown_sql(90)) + (
    "SELECT *, transaction_count > count_p75 AS frequent FROM (SELECT *, "
    "CAST(avg_transaction AS DECIMAL(18,2)) * COUNT(*) OVER w > "
    "SUM(CAST(avg_transaction AS DECIMAL(18,2))) OVER w AS above_average, "
    "percentage > 20 AS significant_share, "
    "quantile_cont(transaction_count, 0.75) OVER w AS count_p75 FROM b "
    "WINDOW w AS (PARTITION BY client_id))")


@register("category_insights", "N", "B12, F13", _INSIGHTS_SQL)
def category_insights(led):
    return sp.category_insights(led, "3_months")


# ---- parameter variants ------------------------------------------------------

@register("category_breakdown_6_months", "N", "B2, F3 (180 days)",
          with_ledger("N", *breakdown_sql(180)) + "SELECT * FROM b")
def category_breakdown_6_months(led):
    return sp.category_breakdown(led, "6_months")


@register("comparison_metrics_1_month", "N", "B8–B11, F6 (30 days)", _comparison_sql(30))
def comparison_metrics_1_month(led):
    return sp.comparison_metrics(led, "1_month")
