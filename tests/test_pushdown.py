"""One client: slicing the ledger (S3) filters every scan; filtering a result
is pushed through aggregates, windows and joins (fully for the simple
operators, partly where the anchor sits behind a bucketed join)."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from spendlens.operators import kpis, merchants, spending
from spendlens.operators.rewards import Rewards
from spendlens.plans.registry import get_ledger
from spendlens.sources.loaders import client_slice

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")

OPS = {
    "category_breakdown": lambda led: spending.category_breakdown(led, "3_months"),
    "comparison_metrics": lambda led: spending.comparison_metrics(led, "3_months"),
    "merchant_stats": lambda led: merchants.merchant_stats(led, "3_months"),
    "monthly_trend": lambda led: kpis.monthly_trend(led, 6),
    "all_kpis": lambda led: kpis.all_kpis(led),
    "optimal": lambda led: Rewards(led, "1_year").optimal(),
}


def _client_scans(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [ln for ln in plan.splitlines() if "FileScan parquet" in ln
            and re.search(r"ReadSchema: struct<[^>]*\bclient_id\b", ln)]


@pytest.mark.parametrize("name", sorted(OPS))
def test_slice_filters_every_scan(spark, name):
    led = client_slice(get_ledger(spark, SF, "O"), 42)
    scans = _client_scans(spark, OPS[name](led))
    assert scans
    for ln in scans:
        assert "EqualTo(client_id,42)" in ln, ln


@pytest.mark.parametrize("name", ["category_breakdown", "merchant_stats", "monthly_trend", "optimal"])
def test_result_filter_reaches_every_scan(spark, name):
    df = OPS[name](get_ledger(spark, SF, "O")).filter(F.col("client_id") == 42)
    scans = _client_scans(spark, df)
    assert scans
    for ln in scans:
        assert "EqualTo(client_id,42)" in ln, ln
