"""Registered forecast / anomaly queries (P1–P4, J8) and their oracles."""

from __future__ import annotations

from spendlens.operators import insights as ins
from spendlens.plans.registry import register
from spendlens.plans.sqlkit import MSD, R, period_cte, with_ledger

_FORECAST_SQL = with_ledger(
    "N", period_cte(365),
    f"mt AS (SELECT client_id, strftime(date, '%Y-%m') AS month_year, CAST({MSD('amount')} AS DOUBLE) "
    "AS amount FROM f GROUP BY client_id, strftime(date, '%Y-%m'))",
    "mx AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY month_year) - 1 "
    "AS DOUBLE) AS x FROM mt)",
    "fit AS (SELECT client_id, COUNT(*) AS n_months, regr_slope(amount, x) AS slope, "
    "regr_intercept(amount, x) AS icpt FROM mx GROUP BY client_id HAVING COUNT(*) >= 3)",
    "st AS (SELECT fit.*, s.step, CAST(n_months + s.step - 1 AS DOUBLE) AS xx FROM fit "
    "JOIN (SELECT range AS step FROM range(1, 4)) s ON TRUE)",
    "pr AS (SELECT *, GREATEST(slope * xx + icpt, 0.0) AS pred FROM st)",
) + (
    "SELECT client_id, CAST(step AS BIGINT) AS step, CAST(xx AS BIGINT) AS month_index, n_months, "
    f"{R('pred', 6)} AS predicted_spending, {R('slope', 6)} AS slope, {R('icpt', 6)} AS intercept, "
    f"{R('AVG(pred) OVER (PARTITION BY client_id)', 6)} AS avg_prediction, "
    f"CASE WHEN {R('slope', 6)} > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction "
    "FROM pr")


@register("linear_forecast", "N", "P1, P2", _FORECAST_SQL)
def linear_forecast(led):
    return ins.linear_forecast(led)


_MEAN_2SD = f"CAST({MSD('amount')} AS DOUBLE) / COUNT(*) + stddev_samp(amount) * 2"
_TH = (f"th AS (SELECT client_id, {R(_MEAN_2SD, 6)} AS threshold FROM tx WHERE amount > 0 "
       "GROUP BY client_id)")


@register("amount_anomalies", "E", "P3, J8", with_ledger("E", _TH) + (
    "SELECT t.client_id, t.id, t.date, t.amount, t.merchant_id, th.threshold, "
    f"'$' || format('{{:,.2f}}', {R('t.amount', 2)}) AS amount_text FROM tx t "
    "JOIN th ON th.client_id = t.client_id WHERE t.amount > 0 AND t.amount > th.threshold"), ts=("date",))
def amount_anomalies(led):
    return ins.amount_anomalies(led)


@register("anomaly_timeline", "E", "P4", with_ledger(
    "E", _TH,
    "tl AS (SELECT client_id, id, date, amount, merchant_id, CAST(row_number() OVER (PARTITION BY "
    "client_id ORDER BY date DESC, id DESC, amount DESC, merchant_id DESC) AS BIGINT) AS position "
    "FROM tx WHERE amount > 0)") + (
    "SELECT tl.*, th.threshold, COALESCE(tl.amount > th.threshold, false) AS is_anomaly FROM tl "
    "LEFT JOIN th ON th.client_id = tl.client_id WHERE tl.position <= 100"), ts=("date",))
def anomaly_timeline(led):
    return ins.anomaly_timeline(led, 100)
