"""Registered merchant-intelligence queries (M1–M11, J2, F10, C13–C18) and
their oracles."""

from __future__ import annotations

from spendlens.operators import merchants as mr
from spendlens.plans.registry import register
from spendlens.plans.sqlkit import MSD, R, categorized_cte, period_cte, q, with_ledger

_NAME_CASE = "CASE merchant_id " + " ".join(
    f"WHEN {k} THEN {q(v)}" for k, v in mr.MERCHANT_NAMES.items()) + " END"


_CONSISTENCY = ("CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CASE WHEN avg_amount > 0 "
                "THEN std_amount / avg_amount ELSE 0.0 END)")
_SPAN = ("first_transaction", "last_transaction")


def stats_sql(days: int) -> list[str]:
    """CTE ``ms``: merchant stats M1–M3."""
    return [
        period_cte(days),
        "fm AS (SELECT * FROM f WHERE merchant_id IS NOT NULL)",
        f"g AS (SELECT client_id, merchant_id, {MSD('amount')} AS d, COUNT(*) AS transaction_count, "
        "stddev_samp(amount) AS sd, min(date) AS first_transaction, max(date) AS last_transaction, "
        "arg_min(mcc, struct_pack(a := date, b := id, c := mcc)) FILTER (WHERE mcc IS NOT NULL) "
        "AS mcc FROM fm GROUP BY client_id, merchant_id)",
        "g2 AS (SELECT client_id, merchant_id, CAST(d AS DOUBLE) AS total_spent, transaction_count, "
        f"{R('CAST(d AS DOUBLE) / transaction_count', 2)} AS avg_amount, "
        f"COALESCE({R('sd', 2)}, 0.0) AS std_amount, first_transaction, last_transaction, mcc "
        "FROM g)",
        categorized_cte("g2", "g3"),
        "ms AS (SELECT *, "
        f"{R(_CONSISTENCY, 3)} AS consistency_score, "
        f"{R(f'transaction_count / CAST({days} AS DOUBLE) * 30', 2)} AS frequency_score, "
        f"COALESCE({_NAME_CASE}, category || ' Merchant ' || CAST(merchant_id AS VARCHAR)) "
        "AS merchant_name FROM g3)",
    ]


CONC_CTE = (
    "c0 AS (SELECT client_id, merchant_id, CAST(total_spent AS DECIMAL(18,2)) AS d, "
    "row_number() OVER (PARTITION BY client_id ORDER BY total_spent DESC, merchant_id) AS rk "
    "FROM ms)",
    "conc AS (SELECT client_id, COUNT(*) AS total_merchants, "
    + ", ".join(
        f"{R(f'CAST(SUM(CASE WHEN rk <= {k} THEN d END) AS DOUBLE) / CAST(SUM(d) AS DOUBLE) * 100', 1)}"
        f" AS top_{k}_percentage" for k in (3, 5, 10))
    + " FROM c0 GROUP BY client_id HAVING SUM(d) <> 0)",
)

SUBS_CTE = (
    "sb AS (SELECT *, "
    f"{R('total_spent / transaction_count', 2)} AS estimated_monthly_cost FROM ms "
    "WHERE consistency_score > 0.8 AND frequency_score >= 0.8 AND transaction_count >= 2)",
)

LOYALTY_CTE = (
    "th AS (SELECT client_id, quantile_cont(total_spent, 0.7) AS spending_threshold, "
    "quantile_cont(frequency_score, 0.7) AS frequency_threshold FROM ms GROUP BY client_id)",
    f"ly AS (SELECT ms.*, {R('th.spending_threshold', 6)} AS spending_threshold, "
    f"{R('th.frequency_threshold', 6)} AS frequency_threshold, "
    f"{R('ms.total_spent * CAST(0.6 AS DOUBLE) + ms.frequency_score * 20 + ms.transaction_count * 2', 2)}"
    " AS loyalty_score, ms.total_spent * CAST(0.02 AS DOUBLE) AS potential_rewards "
    "FROM ms JOIN th ON ms.client_id = th.client_id "
    "WHERE ms.total_spent >= th.spending_threshold OR ms.frequency_score >= th.frequency_threshold)",
)


def vol_cte(days: int) -> tuple[str, ...]:
    ok = "v.active_days >= 2"
    return (
        period_cte(days, name="fv"),
        f"dl AS (SELECT client_id, CAST(date AS DATE) AS day, {MSD('amount')} AS d FROM fv "
        "GROUP BY client_id, CAST(date AS DATE))",
        "v AS (SELECT client_id, COUNT(*) AS active_days, SUM(d) AS t, "
        "stddev_samp(CAST(d AS DOUBLE)) AS sd, max(d) AS mx, min(d) AS mn FROM dl GROUP BY client_id)",
        "vol AS (SELECT client_id, active_days, "
        f"CASE WHEN {ok} THEN {R('CAST(t AS DOUBLE) / active_days', 2)} ELSE 0.0 END AS avg_daily_spending, "
        f"CASE WHEN {ok} THEN {R('sd', 2)} ELSE 0.0 END AS std_daily_spending, "
        f"CASE WHEN {ok} THEN CAST(mx AS DOUBLE) ELSE 0.0 END AS max_daily_spending, "
        f"CASE WHEN {ok} THEN CAST(mn AS DOUBLE) ELSE 0.0 END AS min_daily_spending, "
        f"CASE WHEN {ok} THEN (CASE WHEN CAST(t AS DOUBLE) / active_days > 0 THEN "
        f"{R('sd / (CAST(t AS DOUBLE) / active_days)', 3)} ELSE 0.0 END) ELSE 0.0 END "
        "AS volatility_coefficient FROM v)",
    )


@register("merchant_stats", "N", "M1, M2, M3, J2, F10, C15",
          with_ledger("N", *stats_sql(90)) + "SELECT * FROM ms", ts=_SPAN)
def merchant_stats(led):
    return mr.merchant_stats(led, "3_months")


@register("merchant_concentration", "N", "M4",
          with_ledger("N", *stats_sql(90), *CONC_CTE) + "SELECT * FROM conc")
def merchant_concentration(led):
    return mr.concentration(led, "3_months")


@register("subscriptions", "E", "M5, M6", with_ledger("E", *stats_sql(90), *SUBS_CTE) + (
    "SELECT *, CAST(SUM(CAST(estimated_monthly_cost AS DECIMAL(18,2))) OVER w AS DOUBLE) "
    "AS total_monthly_subscriptions, COUNT(*) OVER w AS subscription_count, "
    "CAST(SUM(CASE WHEN estimated_monthly_cost > 20 THEN 1 ELSE 0 END) OVER w AS BIGINT) "
    "AS high_cost_count FROM sb WINDOW w AS (PARTITION BY client_id)"), ts=_SPAN)
def subscriptions(led):
    return mr.subscriptions(led, "3_months")


@register("loyalty_candidates", "N", "M7, M8",
          with_ledger("N", *stats_sql(90), *LOYALTY_CTE) + "SELECT * FROM ly", ts=_SPAN)
def loyalty_candidates(led):
    return mr.loyalty_candidates(led, "3_months")


@register("spending_volatility", "E", "M9",
          with_ledger("E", *vol_cte(90)) + "SELECT * FROM vol")
def spending_volatility(led):
    return mr.spending_volatility(led, "3_months")


@register("merchant_summary", "N", "M10", with_ledger(
    "N", *stats_sql(90), *CONC_CTE, *LOYALTY_CTE, *vol_cte(90),
    "base AS (SELECT client_id, COUNT(*) AS total_merchants FROM ms GROUP BY client_id)",
    "lc AS (SELECT client_id, COUNT(*) AS loyalty_candidates FROM ly GROUP BY client_id)",
) + (
    "SELECT base.client_id, base.total_merchants, "
    + ", ".join(f"COALESCE(conc.top_{k}_percentage, 0.0) AS top_{k}_percentage" for k in (3, 5, 10))
    + ", vol.avg_daily_spending, vol.std_daily_spending, vol.max_daily_spending, "
    "vol.min_daily_spending, vol.volatility_coefficient, "
    "COALESCE(lc.loyalty_candidates, 0) AS loyalty_candidates FROM base "
    "LEFT JOIN conc ON base.client_id = conc.client_id "
    "LEFT JOIN vol ON base.client_id = vol.client_id "
    "LEFT JOIN lc ON base.client_id = lc.client_id"))
def merchant_summary(led):
    return mr.merchant_summary(led, "3_months")


@register("merchant_recommendations", "N", "M11", with_ledger(
    "N", *stats_sql(90), *SUBS_CTE, *LOYALTY_CTE,
    f"subr AS (SELECT client_id, CAST(1 AS BIGINT) AS seq, {q(mr.SUBSCRIPTION_TYPE)} AS type, "
    f"printf({q(mr.SUBSCRIPTION_TITLE)}, COUNT(*)) AS title, "
    f"printf({q(mr.SUBSCRIPTION_TEXT)}, {R('CAST(SUM(CAST(estimated_monthly_cost AS DECIMAL(18,2))) AS DOUBLE)', 2)}) "
    "AS description, "
    "CASE WHEN CAST(SUM(CAST(estimated_monthly_cost AS DECIMAL(18,2))) AS DOUBLE) > 100 "
    "THEN 'High' ELSE 'Medium' END AS priority, "
    "CAST(SUM(CAST(estimated_monthly_cost AS DECIMAL(18,2))) AS DOUBLE) * CAST(0.2 AS DOUBLE) "
    "AS potential_value, '' AS merchants FROM sb GROUP BY client_id)",
    "lyr AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY loyalty_score DESC, "
    "merchant_id) AS rk FROM ly)",
    f"lr AS (SELECT client_id, CAST(2 AS BIGINT) AS seq, {q(mr.LOYALTY_TYPE)} AS type, "
    f"printf({q(mr.LOYALTY_TITLE)}, COUNT(*)) AS title, "
    f"printf({q(mr.LOYALTY_TEXT)}, {R('CAST(SUM(CAST(total_spent AS DECIMAL(18,2))) AS DOUBLE) * CAST(0.02 AS DOUBLE)', 2)}) "
    "AS description, "
    "'Medium' AS priority, CAST(SUM(CAST(total_spent AS DECIMAL(18,2))) AS DOUBLE) * "
    "CAST(0.02 AS DOUBLE) AS potential_value, string_agg(merchant_name, ', ' ORDER BY rk) "
    "AS merchants FROM lyr WHERE rk <= 3 GROUP BY client_id)",
) + "SELECT * FROM subr UNION ALL SELECT * FROM lr")
def merchant_recommendations(led):
    return mr.merchant_recommendations(led, "3_months")


def _pct_txt(x: str, signed: bool = False) -> str:
    r = R(x, 1)
    t = f"printf('%.1f%%', {r})"
    return f"(CASE WHEN {r} >= 0 THEN '+' || {t} ELSE {t} END)" if signed else t


def _trunc(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END)"


@register("display_labels", "N", "C13, C15, C17, C18", with_ledger(
    "N", *stats_sql(90),
    "dl0 AS (SELECT *, CAST(SUM(CAST(total_spent AS DECIMAL(18,2))) OVER w AS DOUBLE) AS tot, "
    "COUNT(*) OVER w AS n FROM ms WINDOW w AS (PARTITION BY client_id))",
    "dl1 AS (SELECT *, tot / n AS mean, CASE WHEN tot > 0 THEN total_spent / tot * 100 ELSE 0.0 "
    "END AS share FROM dl0)",
    "dl2 AS (SELECT *, CASE WHEN mean > 0 THEN (total_spent - mean) / mean * 100 ELSE 0.0 END "
    "AS vs FROM dl1)",
) + (
    f"SELECT client_id, merchant_id, merchant_name, {_trunc('merchant_name', 20)} AS short_name, "
    f"{_trunc('category', 25)} AS category_label, {R('total_spent', 1)} AS total_1dp, "
    f"'$' || format('{{:,.2f}}', {R('total_spent', 2)}) AS total_text, "
    f"'$' || format('{{:,.2f}}', {R('avg_amount', 2)}) AS avg_text, "
    f"{_pct_txt('share')} AS share_text, {_pct_txt('vs', True)} AS vs_average_text FROM dl2"))
def display_labels(led):
    return mr.display_labels(led, "3_months")


# ---- parameter variants ------------------------------------------------------

@register("merchant_stats_last_year", "N", "M1–M3, F10 ('Last Year' = 365 days)",
          with_ledger("N", *stats_sql(365)) + "SELECT * FROM ms", ts=_SPAN)
def merchant_stats_last_year(led):
    return mr.merchant_stats(led, "Last Year")
