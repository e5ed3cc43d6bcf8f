"""Forecast and anomalies (P1–P4), for all clients at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.exprs import clamp_min, money_sum_dec, money_text, round_dec
from spendlens.functions.periods import spend_only
from spendlens.operators.spending import monthly_totals
from spendlens.plans.joins import attach_per_client, top_k_per_group
from spendlens.sources.schema import Ledger

MIN_MONTHS = 3
HORIZON = 3
ANOMALY_SIGMAS = 2


def linear_forecast(ledger: Ledger, period: str = "1_year", horizon: int = HORIZON) -> DataFrame:
    """P1 + P2: least-squares line through the client's monthly purchase
    totals (x = 0..n-1 over the months that have data, n >= 3), the next
    ``horizon`` months clamped at 0, their mean and the trend direction.
    Figures are rounded to 6 places (N3)."""
    m = monthly_totals(ledger, period)
    w = Window.partitionBy("client_id").orderBy("month_year")
    m = m.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    fit = m.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.regr_slope("amount", "x").alias("_slope"),
        F.regr_intercept("amount", "x").alias("_icpt")).filter(
        F.col("n_months") >= MIN_MONTHS)
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    x = (F.col("n_months") + F.col("step") - 1).cast("double")
    pred = clamp_min(F.col("_slope") * x + F.col("_icpt"), 0.0)
    steps = steps.withColumn("_pred", pred)
    avg = F.avg("_pred").over(Window.partitionBy("client_id"))
    return steps.select(
        "client_id", F.col("step").cast("long").alias("step"),
        x.cast("long").alias("month_index"), "n_months",
        round_dec("_pred", 6).alias("predicted_spending"),
        round_dec("_slope", 6).alias("slope"), round_dec("_icpt", 6).alias("intercept"),
        round_dec(avg, 6).alias("avg_prediction"),
        F.when(round_dec("_slope", 6) > 0, "increasing").otherwise("decreasing")
        .alias("trend_direction"))


def anomaly_thresholds(ledger: Ledger, sigmas: int = ANOMALY_SIGMAS) -> DataFrame:
    """Per client: mean + ``sigmas`` · sample std of all its purchases,
    rounded to 6 places (one purchase → no threshold)."""
    tx = spend_only(ledger.transactions)
    s = tx.groupBy("client_id").agg(
        money_sum_dec("amount").alias("_t"), F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("amount").alias("_std"))
    mean = F.col("_t").cast("double") / F.col("_n")
    return s.select("client_id", round_dec(mean + F.col("_std") * sigmas, 6).alias("threshold"))


def amount_anomalies(ledger: Ledger, sigmas: int = ANOMALY_SIGMAS) -> DataFrame:
    """P3 (+ J8): purchases above the client's threshold."""
    tx = spend_only(ledger.transactions).select("client_id", "id", "date", "amount",
                                                "merchant_id")
    df = attach_per_client(ledger, tx, anomaly_thresholds(ledger, sigmas))
    return (df.filter(F.col("amount") > F.col("threshold"))
              .withColumn("amount_text", money_text("amount")))


def anomaly_timeline(ledger: Ledger, last: int = 100, sigmas: int = ANOMALY_SIGMAS) -> DataFrame:
    """The client's last ``last`` purchases (latest first), flagged
    against the threshold."""
    tx = spend_only(ledger.transactions).select("client_id", "id", "date", "amount",
                                                "merchant_id")
    top = top_k_per_group(tx, ["client_id"],
                          [F.col("date").desc(), F.col("id").desc(), F.col("amount").desc(),
                           F.col("merchant_id").desc()], last, rank_col="position",
                          salt_cols=["id", "date", "amount"])
    df = attach_per_client(ledger, top, anomaly_thresholds(ledger, sigmas), "left")
    return df.withColumn("is_anomaly", F.coalesce(F.col("amount") > F.col("threshold"),
                                                  F.lit(False)))
