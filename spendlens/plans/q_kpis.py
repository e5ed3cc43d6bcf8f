"""Registered overview-KPI queries (A1–A10, F5, F7, J3, J5) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.operators import kpis
from spendlens.plans.registry import register
from spendlens.plans.sqlkit import DB, MSD, R, anchor_cte, categorized_cte, with_ledger

B = "O"


def _in_months(m: int) -> str:
    return f"(t.amount > 0 AND t.date >= {DB('a.anchor', 30 * m)})"


def _weight(months: int = 12) -> str:
    return " + ".join(f"(CASE WHEN {_in_months(m)} THEN 1 ELSE 0 END)"
                      for m in range(1, months + 1))


_LIMITS = ("l AS (SELECT client_id, CAST(SUM(CAST(credit_limit AS DECIMAL(18,2))) AS DOUBLE) "
           "AS lim FROM cards GROUP BY client_id)")

_LABELS = ("lb AS (SELECT transaction_id, COUNT(*) AS ln, COUNT(*) FILTER (WHERE is_fraud) AS lf "
           "FROM fraud GROUP BY transaction_id)")

_CORE = (
    "core AS (SELECT t.client_id, "
    f"SUM(CASE WHEN {_in_months(1)} THEN CAST(t.amount AS DECIMAL(18,2)) END) AS m, "
    f"SUM(CAST(t.amount AS DECIMAL(18,2)) * ({_weight()})) AS w, "
    "CAST(SUM(COALESCE(lb.lf, 0)) AS BIGINT) AS fr, CAST(SUM(COALESCE(lb.ln, 1)) AS BIGINT) AS n "
    "FROM tx t JOIN anch a ON t.client_id = a.client_id "
    "LEFT JOIN lb ON t.id = lb.transaction_id GROUP BY t.client_id)")

_SPEND = "COALESCE(CAST(core.m AS DOUBLE), 0.0)"
_UTIL = (f"CASE WHEN l.lim IS NULL OR l.lim = 0 THEN 0.0 ELSE LEAST({_SPEND} / l.lim * 100, 100.0) "
         "END")
_INTEREST = ("CASE WHEN u.total_debt IS NULL OR u.total_debt = 0 THEN 0.0 "
             "ELSE u.total_debt * CAST(0.18 AS DOUBLE) / 12 * 12 END")
_REWARDS = "COALESCE(CAST(core.w AS DOUBLE), 0.0) * CAST(0.01 AS DOUBLE)"
_FRAUD = "CASE WHEN core.n > 0 THEN CAST(core.fr AS DOUBLE) / core.n * 100 ELSE 0.0 END"


def _month_sql(m: int) -> str:
    return with_ledger(
        B, anchor_cte(),
        f"s AS (SELECT t.client_id, {MSD('t.amount')} AS d FROM tx t JOIN anch a "
        f"ON t.client_id = a.client_id WHERE {_in_months(m)} GROUP BY t.client_id)")


@register("monthly_spending", B, "A1, F5", _month_sql(1) + (
    "SELECT u.id AS client_id, COALESCE(CAST(s.d AS DOUBLE), 0.0) AS monthly_spending "
    "FROM users u LEFT JOIN s ON u.id = s.client_id"))
def monthly_spending(led):
    return kpis.monthly_spending(led, 1)


@register("credit_utilization", B, "A2, C19, C20", with_ledger(
    B, anchor_cte(),
    f"s AS (SELECT t.client_id, {MSD('t.amount')} AS d FROM tx t JOIN anch a "
    f"ON t.client_id = a.client_id WHERE {_in_months(1)} GROUP BY t.client_id)", _LIMITS) + (
    "SELECT u.id AS client_id, COALESCE(CAST(s.d AS DOUBLE), 0.0) AS monthly_spending, "
    "COALESCE(l.lim, 0.0) AS total_credit_limit, "
    "CASE WHEN l.lim IS NULL OR l.lim = 0 THEN 0.0 ELSE "
    "LEAST(COALESCE(CAST(s.d AS DOUBLE), 0.0) / l.lim * 100, 100.0) END AS credit_utilization "
    "FROM users u LEFT JOIN s ON u.id = s.client_id LEFT JOIN l ON u.id = l.client_id"))
def credit_utilization(led):
    return kpis.credit_utilization(led)


@register("interest_paid", B, "A3", with_ledger(B) + (
    f"SELECT u.id AS client_id, u.total_debt, {_INTEREST} AS interest_paid FROM users u"))
def interest_paid(led):
    return kpis.interest_paid(led, 12)


@register("rewards_earned", B, "A4", with_ledger(B, anchor_cte(), _LABELS, _CORE) + (
    f"SELECT u.id AS client_id, {_REWARDS} AS rewards_earned "
    "FROM users u LEFT JOIN core ON u.id = core.client_id"))
def rewards_earned(led):
    return kpis.rewards_earned(led, 12)


@register("fraud_risk", B, "A6, J3", with_ledger(B, anchor_cte(), _LABELS, _CORE) + (
    "SELECT u.id AS client_id, COALESCE(core.n, 0) AS transactions, "
    f"COALESCE(core.fr, 0) AS fraud_transactions, {_FRAUD} AS fraud_risk_score "
    "FROM users u LEFT JOIN core ON u.id = core.client_id"))
def fraud_risk(led):
    return kpis.fraud_risk(led)


def _by_category_sql(m: int = 3) -> list[str]:
    return [
        anchor_cte(),
        f"f AS (SELECT t.* FROM tx t JOIN anch a ON t.client_id = a.client_id WHERE {_in_months(m)})",
        categorized_cte("f", "fc"),
        f"g AS (SELECT client_id, category, {MSD('amount')} AS d, COUNT(*) AS transactions "
        "FROM fc GROUP BY client_id, category)",
        "h AS (SELECT client_id, category, CAST(d AS DOUBLE) AS amount, transactions, "
        "CAST(SUM(d) OVER w AS DOUBLE) AS total_spending, COUNT(*) OVER w AS category_count "
        "FROM g WINDOW w AS (PARTITION BY client_id))",
        "k AS (SELECT *, CASE WHEN total_spending > 0 THEN "
        f"{R('amount / total_spending * 100', 1)} ELSE 0.0 END AS percentage FROM h)",
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY amount DESC, "
        "category) AS BIGINT) AS rank FROM k)",
        "sbc AS (SELECT *, rank <= 10 AS in_top10, CAST(SUM(CASE WHEN rank <= 5 THEN "
        "CAST(percentage AS DECIMAL(10,1)) END) OVER (PARTITION BY client_id) AS DOUBLE) "
        "AS top5_share FROM r)",
    ]


@register("spending_by_category", B, "A5, A10, J1",
          with_ledger(B, *_by_category_sql(3)) + "SELECT * FROM sbc")
def spending_by_category(led):
    return kpis.spending_by_category(led, 3)


def _trend_sql(months: int = 6) -> str:
    cases = " ".join(
        f"WHEN t.date >= {DB('a.anchor', 30 * (i + 1))} AND t.date < {DB('a.anchor', 30 * i)} "
        f"THEN {i}" for i in range(months))
    return with_ledger(
        B, anchor_cte(),
        f"b AS (SELECT t.client_id, t.amount, CASE {cases} END AS bucket FROM tx t JOIN anch a "
        "ON t.client_id = a.client_id WHERE t.amount > 0)",
        f"s AS (SELECT client_id, bucket, {MSD('amount')} AS d FROM b WHERE bucket IS NOT NULL "
        "GROUP BY client_id, bucket)",
        f"k AS (SELECT a.client_id, a.anchor, r.bucket FROM anch a JOIN (SELECT CAST(range AS "
        f"INTEGER) AS bucket FROM range(0, {months})) r ON TRUE)",
    ) + (
        f"SELECT k.client_id, CAST({months - 1} - k.bucket AS BIGINT) AS position, "
        "strftime(k.anchor - to_days(CAST((k.bucket + 1) * 30 AS INTEGER)), '%B %Y') AS month, "
        "COALESCE(CAST(s.d AS DOUBLE), 0.0) AS spending FROM k LEFT JOIN s "
        "ON k.client_id = s.client_id AND k.bucket = s.bucket")


@register("monthly_trend", B, "A7, F7", _trend_sql(6))
def monthly_trend(led):
    return kpis.monthly_trend(led, 6)


_PROFILE_SQL = with_ledger(
    B,
    "c AS (SELECT client_id, COUNT(*) AS card_count, string_agg(concat_ws('|', CAST(id AS VARCHAR), "
    "card_brand, card_type, CAST(CAST(credit_limit AS DECIMAL(18,2)) AS VARCHAR), "
    "strftime(expires, '%Y-%m-%d')), ';' ORDER BY id) AS cards_text, CAST(to_json(list(struct_pack(card_id := id, "
    "card_brand := card_brand, card_type := card_type, credit_limit := credit_limit, expires := expires, "
    "label := card_brand || ' (' || card_type || ')') ORDER BY id)) AS VARCHAR) AS cards FROM cards GROUP BY client_id)",
) + (
    "SELECT u.id AS user_id, u.current_age AS age, u.gender, u.address, u.yearly_income, "
    "u.total_debt, u.credit_score, u.num_credit_cards, COALESCE(c.card_count, 0) AS card_count, "
    "COALESCE(c.cards_text, '') AS cards_text, c.cards FROM users u LEFT JOIN c ON u.id = c.client_id")


@register("user_profile", B, "A8, J5", _PROFILE_SQL)
def user_profile(led):
    # The nested list as JSON text, the same on both sides.
    return kpis.user_profile(led).withColumn("cards", F.to_json("cards", {"ignoreNullFields": "false"}))


_ALL_SQL = with_ledger(
    B, anchor_cte(), _LABELS, _CORE, _LIMITS,
    *_by_category_sql(3)[1:],
    "cat AS (SELECT client_id, COUNT(*) AS spending_categories FROM sbc GROUP BY client_id)",
) + (
    f"SELECT u.id AS client_id, {_SPEND} AS total_monthly_spending, {_UTIL} AS credit_utilization, "
    f"{_INTEREST} AS interest_paid, {_REWARDS} AS rewards_earned, "
    "CAST(COALESCE(u.credit_score, 0) AS BIGINT) AS credit_score, "
    f"{_FRAUD} AS fraud_risk_score, COALESCE(cat.spending_categories, 0) AS spending_categories "
    "FROM users u LEFT JOIN core ON u.id = core.client_id LEFT JOIN l ON u.id = l.client_id "
    "LEFT JOIN cat ON u.id = cat.client_id")


ALL_KPIS_SQL = _ALL_SQL


@register("all_kpis", B, "A9", _ALL_SQL)
def all_kpis(led):
    return kpis.all_kpis(led)
