"""Time windows anchored per client.

The anchor of a client is the latest ``date`` among its transactions, either
all of them (rule ``"all"``) or only the spend rows (rule ``"spend"``).  Both
come from the ledger's table of client activity, never from a window over a
whole client; a stored ledger has it ready, so the transactions are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.exprs import col
from spendlens.plans.joins import attach_per_client
from spendlens.sources.schema import MONTH_COL, Ledger

# Period keys and their day counts; unknown keys mean 90 days.
PERIOD_DAYS = {"1_month": 30, "3_months": 90, "6_months": 180, "1_year": 365, "Last Year": 365}
DEFAULT_PERIOD_DAYS = 90

# Reward periods (days, annualising multiplier); anything else is one year.
REWARD_PERIODS = {"3_months": (90, 4), "6_months": (180, 2)}
DEFAULT_REWARD_PERIOD = (365, 1)


def period_days(period: str | int) -> int:
    if isinstance(period, int):
        return period
    return PERIOD_DAYS.get(period, DEFAULT_PERIOD_DAYS)


def reward_period(period: str) -> tuple[int, int]:
    return REWARD_PERIODS.get(period, DEFAULT_REWARD_PERIOD)


def days_before(c: str | Column, days: int) -> Column:
    """``c - INTERVAL days DAYS``."""
    return col(c) - F.make_dt_interval(days=F.lit(days))


def spend_only(df: DataFrame) -> DataFrame:
    """purchases only (refunds and zero rows dropped)."""
    return df.filter(F.col("amount") > 0)


def anchors(ledger: Ledger, rule: str = "all") -> DataFrame:
    """F8: ``(client_id, anchor)`` — latest date per client."""
    if rule not in ("all", "spend"):
        raise ValueError(f"unknown anchor rule {rule!r}")
    last = "last_purchase" if rule == "spend" else "last_date"
    return ledger.client_activity().select("client_id", F.col(last).alias("anchor"))


def with_anchor(ledger: Ledger, df: DataFrame | None = None, rule: str = "all") -> DataFrame:
    df = ledger.transactions if df is None else df
    return attach_per_client(ledger, df, anchors(ledger, rule))


def since(ledger: Ledger, days: int, rule: str = "all") -> DataFrame:
    """Transactions without the months that lie wholly before the earliest
    ``anchor - days`` of any client.  Only a ledger stored by months is pruned:
    the bound is a scalar subquery over its activity table, so Spark skips the
    months' files at run time; any other ledger comes back as it is."""
    tx = ledger.transactions
    if MONTH_COL not in tx.columns or ledger.activity is None:
        return tx
    least = days_before(F.min("anchor"), days)
    bound = anchors(ledger, rule).agg((F.year(least) * 100 + F.month(least)).alias("bound"))
    return tx.where(F.col(MONTH_COL) >= F.coalesce(bound.scalar(), F.lit(0)))


def recent(ledger: Ledger, days: int, rule: str = "all", columns: tuple[str, ...] = ()) -> DataFrame:
    """rows of the last ``days`` days before their client's
    anchor (lower bound inclusive), with ``anchor``."""
    tx = since(ledger, days, rule)
    df = with_anchor(ledger, tx.select(*columns) if columns else tx.drop(MONTH_COL), rule)
    return df.filter(F.col("date") >= days_before("anchor", days))


def relative_period(ledger: Ledger, period: str | int = "3_months", rule: str = "all",
                    spend: bool = True) -> DataFrame:
    """rows with ``date >= anchor - days`` (lower bound inclusive)."""
    df = recent(ledger, period_days(period), rule)
    return spend_only(df) if spend else df


def custom_range(ledger: Ledger, start: str, end: str, spend: bool = True) -> DataFrame:
    """``start <= date <= end``; ``end`` is a date at 00:00, so later times
    on the end day fall out."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    df = ledger.transactions.filter((F.col("date") >= lo) & (F.col("date") <= hi))
    if MONTH_COL in df.columns:
        month = lambda x: F.year(x) * 100 + F.month(x)
        df = df.filter(F.col(MONTH_COL).between(month(lo), month(hi))).drop(MONTH_COL)
    return spend_only(df) if spend else df
