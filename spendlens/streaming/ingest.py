"""Incremental loading of the raw transaction feed (S1 + C1–C5, streaming).

The reference reads its transaction CSV in batch; when the same header-CSV
files keep arriving in a folder, Structured Streaming applies exactly the
same cleaning to each new file and appends typed rows to a Parquet table,
which is then the ``transactions`` table of a :class:`Ledger`.  Progress is
kept in a checkpoint under the cluster's shared ``spark.checkpoint.dir``, so
a restarted job (or a lost executor) resumes without duplicates.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendlens.functions.cleaning import clean_transactions
from spendlens.session import ensure_checkpoint_dir
from spendlens.sources.schema import TRANSACTIONS, conform

# Column names of the raw transaction file, in file order.
RAW_TRANSACTION_COLUMNS = ["id", "date", "client_id", "card_id", "amount", "use_chip",
                           "merchant_id", "merchant_city", "merchant_state", "zip", "mcc",
                           "errors"]


def raw_schema(columns: list[str] = RAW_TRANSACTION_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def transaction_stream(spark: SparkSession, source_dir: str,
                       columns: list[str] = RAW_TRANSACTION_COLUMNS,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned, typed transactions from new CSV files."""
    r = spark.readStream.option("header", True).schema(raw_schema(columns))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return conform(clean_transactions(r.csv(source_dir)), TRANSACTIONS)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """``name`` under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder before streaming")
    return os.path.join(base, name)


def start_ingest(spark: SparkSession, source_dir: str, table_path: str,
                 checkpoint: str | None = None, available_now: bool = True,
                 columns: list[str] = RAW_TRANSACTION_COLUMNS) -> StreamingQuery:
    """Append the cleaned rows of every new file to the Parquet table at
    ``table_path``; ``available_now`` processes what is there and stops."""
    ckpt = checkpoint or checkpoint_location(spark, "spendlens-ingest-transactions")
    w = (transaction_stream(spark, source_dir, columns).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(table_path)
