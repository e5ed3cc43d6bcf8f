"""SQL text for the DuckDB oracle: the ledger bindings as CTEs and the
numeric helpers of rules N1–N2, so each oracle query is short and uses the
same arithmetic as the Spark operators."""

from __future__ import annotations

from spendlens.sources.bindings import BRANDS, EVENT_MCC, MCC_CATEGORIES, MCC_MAX_LISTED


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def MS(x: str) -> str:
    """Exact money sum as DOUBLE."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def MSD(x: str) -> str:
    """Exact money sum kept as DECIMAL."""
    return f"SUM(CAST({x} AS DECIMAL(18,2)))"


def R(x: str, k: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,8)), {k}) AS DOUBLE)"


def DB(x: str, days: int) -> str:
    return f"({x} - INTERVAL {days} DAY)"


def SDIV(n: str, d: str) -> str:
    return f"(CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0 END)"


def PCT(cur: str, prev: str) -> str:
    return f"(CASE WHEN {prev} > 0 THEN ({cur} - {prev}) / {prev} * 100 ELSE 0.0 END)"


def _users(key: str, name: str, debt: str, src: str) -> str:
    k = f"CAST({key} AS BIGINT)"
    return (f"SELECT {k} AS id, CAST(18 + {k} % 60 AS INTEGER) AS current_age, "
            f"CASE WHEN {k} % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, "
            f"{name} AS address, CAST(20000 + ({k} * 37) % 80000 AS DOUBLE) AS yearly_income, "
            f"CAST({debt} AS DOUBLE) AS total_debt, "
            f"CAST(500 + ({k} * 13) % 350 AS INTEGER) AS credit_score, "
            f"CAST({k} % 4 AS INTEGER) AS num_credit_cards FROM {src}")


USERS_SQL = {
    "O": _users("c_custkey", "c_name", "c_acctbal", "customer"),
    "N": _users("n_nationkey", "n_name", "0.0", "nation"),
    "E": _users("c_custkey", "c_name", "c_acctbal",
                "customer WHERE c_custkey IN (SELECT user_id FROM events)"),
}

CARDS_SQL = (
    "SELECT u.id * 10 + r.k AS id, u.id AS client_id, "
    f"{arr(BRANDS)}[CAST((u.id + r.k) % 5 + 1 AS INTEGER)] AS card_brand, "
    "CASE WHEN r.k % 2 = 1 THEN 'Credit' ELSE 'Debit' END AS card_type, "
    "make_date(CAST(2024 + (u.id + r.k) % 6 AS INTEGER), CAST((u.id * 3 + r.k) % 12 + 1 AS INTEGER), 1)"
    " AS expires, "
    "CAST(1000 * ((u.id * 7 + r.k * 3) % 20) AS DOUBLE) AS credit_limit "
    "FROM users u JOIN (SELECT CAST(range AS BIGINT) AS k FROM range(1, 4)) r ON r.k <= u.id % 4"
)

MCC_SQL = (f"SELECT CAST(i AS INTEGER) AS mcc, {arr(MCC_CATEGORIES)}[CAST(i % 8 + 1 AS INTEGER)]"
           f" AS category FROM (SELECT range AS i FROM range(1, {MCC_MAX_LISTED + 1}))")

FRAUD_SQL = "SELECT doc_id AS transaction_id, toxic = 1 AS is_fraud FROM labels"

_AMOUNT = "CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END"
_CAL = ("CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
        "CAST(day(date) AS INTEGER) AS day")


def _line_tx(client: str, extra_join: str) -> str:
    return (f"SELECT *, {_CAL} FROM (SELECT l.l_orderkey AS id, {client} AS client_id, "
            "CAST(NULL AS BIGINT) AS card_id, l.l_suppkey AS merchant_id, p.p_size AS mcc, "
            f"CAST(NULL AS DOUBLE) AS zip, {_AMOUNT} AS amount, o.o_orderdate AS date "
            "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
            f"JOIN part p ON l.l_partkey = p.p_partkey {extra_join})")


_EVENT_MCC = "CASE event_type " + " ".join(
    f"WHEN {q(t)} THEN {i}" for i, t in enumerate(EVENT_MCC, start=1)) + " END"

TX_SQL = {
    "O": _line_tx("o.o_custkey", ""),
    "N": _line_tx("CAST(c.c_nationkey AS BIGINT)",
                  "JOIN customer c ON o.o_custkey = c.c_custkey"),
    "E": (f"SELECT *, {_CAL} FROM (SELECT event_id AS id, user_id AS client_id, "
          "CAST(NULL AS BIGINT) AS card_id, "
          "TRY_CAST(NULLIF(regexp_extract(props, '[0-9]+', 0), '') AS BIGINT) AS merchant_id, "
          f"CAST({_EVENT_MCC} AS INTEGER) AS mcc, CAST(NULL AS DOUBLE) AS zip, "
          "value AS amount, ts AS date FROM events)"),
}


def ledger_ctes(binding: str) -> str:
    """``users, cards, tx, mcc, fraud`` for one binding (no leading WITH)."""
    return (f"users AS ({USERS_SQL[binding]}), cards AS ({CARDS_SQL}), "
            f"tx AS ({TX_SQL[binding]}), mcc AS ({MCC_SQL}), fraud AS ({FRAUD_SQL})")


def with_ledger(binding: str, *ctes: str) -> str:
    """``WITH <ledger>, <ctes...>`` prefix."""
    parts = [ledger_ctes(binding), *ctes]
    return "WITH " + ", ".join(parts) + " "


def anchor_cte(name: str = "anch", rule: str = "all") -> str:
    where = "WHERE amount > 0 " if rule == "spend" else ""
    return f"{name} AS (SELECT client_id, max(date) AS anchor FROM tx {where}GROUP BY client_id)"


def period_cte(days: int, name: str = "f", rule: str = "all", spend: bool = True,
               keep_anchor: bool = False) -> str:
    """Rows of ``tx`` in ``[anchor - days, ...]`` (+ purchases only)."""
    cond = " AND t.amount > 0" if spend else ""
    sel = "t.*, a.anchor" if keep_anchor else "t.*"
    where = "WHERE amount > 0 " if rule == "spend" else ""
    return (f"{name} AS (SELECT {sel} FROM tx t JOIN (SELECT client_id, max(date) AS anchor "
            f"FROM tx {where}GROUP BY client_id) a ON t.client_id = a.client_id "
            f"WHERE t.date >= {DB('a.anchor', days)}{cond})")


def categorized_cte(src: str, name: str) -> str:
    return (f"{name} AS (SELECT s.*, COALESCE(m.category, 'Other') AS category FROM {src} s "
            f"LEFT JOIN mcc m ON s.mcc = m.mcc)")
