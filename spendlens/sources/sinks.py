"""CSV exports.

Every export is a distributed ``DataFrame.write`` of a header CSV directory;
nothing is collected to the driver.  The table-shaped exports (category
breakdown, top merchants, rewards analysis) write the operator's result as
is; the two text-shaped ones are built here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.exprs import round_dec

# The four metric names of the patterns summary, in order, and
# the action-plan wording and current-rate text.
PATTERN_METRICS = ("Total Transactions", "Average Transaction", "Largest Transaction",
                   "Smallest Transaction")
ACTION_TEXT = "Use %s for %s"
CURRENT_RATE_TEXT = "1%"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV directory at ``path``."""
    df.write.option("header", True).mode(mode).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def patterns_summary(patterns: DataFrame) -> DataFrame:
    """The four headline figures of the spending patterns (B7 rows with
    ``dimension = 'all'``) as long ``(client_id, Metric, Value)`` rows."""
    p = patterns.filter(F.col("dimension") == "all")

    def money(c: str):
        return F.format_string("$%.2f", round_dec(c, 2))

    wide = p.select(
        "client_id",
        F.col("transactions").cast("string").alias("total"),
        money("avg_transaction").alias("avg"), money("max_transaction").alias("mx"),
        money("min_transaction").alias("mn"))
    pairs = ", ".join(f"'{m}', {c}" for m, c in zip(PATTERN_METRICS, ("total", "avg", "mx", "mn")))
    return wide.select("client_id", F.expr(f"stack(4, {pairs}) AS (Metric, Value)"))


def action_plan(extra: DataFrame) -> DataFrame:
    """The action-plan rows (R16) — Priority, Action, Current_Rate,
    New_Rate, Annual_Gain."""
    a = extra.filter(F.col("action_priority") > 0)
    return a.select(
        "client_id",
        F.col("action_priority").alias("Priority"),
        F.format_string(ACTION_TEXT, "best_card", "category")
        .alias("Action"),
        F.lit(CURRENT_RATE_TEXT).alias("Current_Rate"),
        F.format_string("%.1f%%", round_dec("best_reward_rate", 1)).alias("New_Rate"),
        F.format_string("$%.2f", round_dec("additional_rewards", 2)).alias("Annual_Gain"))
