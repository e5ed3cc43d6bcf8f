"""Streaming ingestion gives the same rows as the batch loader."""

from __future__ import annotations

import os

from spendlens.functions.cleaning import clean_transactions
from spendlens.sources.schema import TRANSACTIONS, conform
from spendlens.streaming import start_ingest
from spendlens.streaming.ingest import raw_schema

HEADER = ("id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,"
          "zip,mcc,errors\n")


def test_available_now_ingest_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(
        HEADER + "1,2010-01-01 00:01:00,7,70,$-77.00,Swipe,59935,Beulah,ND,58523.0,5499,\n"
        "2,2010-01-01 00:02:00,7,70,\"$1,204.50\",Swipe,67570,La Verne,CA,91750.0,5311,\n")
    (src / "b.csv").write_text(
        HEADER + "3,bad date,8,80,abc,Chip,27092,Vista,CA,92084.0,,\n")
    out, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    q = start_ingest(spark, str(src), out, checkpoint=ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = conform(clean_transactions(
        spark.read.option("header", True).schema(raw_schema()).csv(str(src))), TRANSACTIONS)
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    # a second run over the same files adds nothing (checkpointed progress)
    start_ingest(spark, str(src), out, checkpoint=ckpt).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    assert os.path.isdir(ckpt)
