"""The stored ledger: what a deployment keeps between loads.

::

    path/users, path/cards, path/mcc_codes, path/fraud_labels   Parquet
    path/transactions/load=<n>/tx_month=<yyyymm>/               Parquet
    path/ids/load=<n>/                                          Parquet, bucketed by id
    path/labels/load=0/                                         Parquet, bucketed by id
    path/schema/load=<n>/                                       the transactions' columns
    path/activity/load=<n>/                                     Parquet

* **Months.**  A period operator keeps rows with ``date >= anchor - days`` of
  their client, so none from before ``min(anchor) - days``.  That bound is a
  scalar subquery over the small activity table and prunes months at run time
  (``periods.since``).
* **Activity.**  One row a client (latest date, latest purchase, count), updated
  per load from the load's rows and the activity before: no load reads older
  transactions, and operators read the transactions once.
* **Buckets.**  ``ids`` (one row for each transaction id and client, with its
  number of rows) and ``labels`` lie in the same number of buckets by id, so
  labels meet transactions without an exchange.
* **Commit.**  A load counts once its activity is there (written last); what a
  broken load left is not read, and is overwritten by the next load.

Files come from a range partitioning over (month, client, date), so a hot month
or client is cut into files of about one size.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.sources.schema import MONTH_COL, SCHEMAS, Ledger, conform

#: Buckets of transaction ids; fixed once a store is made.
BUCKETS = 16
_DIMS = ("users", "cards", "mcc_codes", "fraud_labels")
_IDS = "id long, client_id long, n long, load int"
_LABELS = "transaction_id long, labels long, frauds long, load int"


def month_number(c: str = "date"):
    """``yyyymm`` of a date as a number (0 without a date)."""
    d = F.col(c)
    return F.coalesce(F.year(d) * 100 + F.month(d), F.lit(0)).cast("int")


def loads(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete loads, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/activity")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    at = [s.getPath() for s in fs.listStatus(root)]
    done = [p for p in at if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def activity_of(tx: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Activity of the clients of ``tx``, added to the one ``before``."""
    date = F.col("date")
    one = tx.select("client_id", date.alias("last_date"), F.when(F.col("amount") > 0, date).alias("last_purchase"),
                    F.lit(1).cast("long").alias("n_transactions"))
    return (one if before is None else one.unionByName(before)).groupBy("client_id").agg(
        F.max("last_date").alias("last_date"), F.max("last_purchase").alias("last_purchase"),
        F.sum("n_transactions").alias("n_transactions"))


def _bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write Parquet in buckets by ``key``; the table's name is only a handle."""
    name = f"spendlens_{hashlib.sha1(path.encode()).hexdigest()[:16]}"
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # external: the files stay


def _write_load(tx: DataFrame, path: str, n: int, before: DataFrame | None, buckets: int) -> None:
    month = tx.withColumn(MONTH_COL, month_number())
    (month.repartitionByRange(MONTH_COL, "client_id", "date").sortWithinPartitions(MONTH_COL, "client_id", "date")
     .write.mode("overwrite").partitionBy(MONTH_COL).parquet(f"{path}/transactions/load={n}"))
    spark = tx.sparkSession
    spark.createDataFrame([(month.schema.json(),)], "schema string").write.mode("overwrite").text(f"{path}/schema/load={n}")
    mine = spark.read.schema(month.schema).parquet(f"{path}/transactions/load={n}")
    ids = mine.where("id is not null").groupBy("id", "client_id").agg(F.count(F.lit(1)).alias("n"))
    _bucketed(ids, f"{path}/ids/load={n}", "id", buckets)
    activity_of(mine, before).write.mode("overwrite").parquet(f"{path}/activity/load={n}")


def save_ledger(ledger: Ledger, path: str, buckets: int = BUCKETS) -> None:
    """Make a store of the five tables; its transactions are load 1."""
    path = path.rstrip("/")
    for name in _DIMS:
        df = ledger.tables()[name]
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    labels = (ledger.fraud_labels.where("transaction_id is not null").groupBy("transaction_id")
              .agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("is_fraud")).alias("frauds")))
    _bucketed(labels, f"{path}/labels/load=0", "transaction_id", buckets)
    _write_load(ledger.transactions.drop(MONTH_COL), path, 1, None, buckets)


def append_transactions(spark: SparkSession, path: str, tx: DataFrame, buckets: int = BUCKETS) -> int:
    """Add transactions as one more load; returns its number."""
    path = path.rstrip("/")
    done = loads(spark, path)
    if not done:
        raise ValueError(f"no ledger is stored at {path!r}")
    n = done[-1] + 1
    before = spark.read.parquet(f"{path}/activity/load={done[-1]}")
    _write_load(tx.drop(MONTH_COL), path, n, before, buckets)
    return n


def _table(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A bucketed folder of loads as a table that Spark knows the buckets of."""
    name = f"spendlens_{hashlib.sha1(path.encode()).hexdigest()[:16]}_{buckets}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet OPTIONS (path '{path}') "
              f"PARTITIONED BY (load) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def load_stored(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Ledger:
    """The ledger of all complete loads, with activity, months and buckets."""
    path = path.rstrip("/")
    done = loads(spark, path)
    if not done:
        raise ValueError(f"no ledger is stored at {path!r}")
    tables = {}
    for name in _DIMS:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
        tables[name] = spark.read.parquet(f"{path}/{name}") if there else None
    columns = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema/load={done[-1]}").first().value))
    tx = (spark.read.schema(columns.add("load", T.IntegerType())).parquet(f"{path}/transactions")
          .where(F.col("load") <= done[-1]).drop("load"))
    ids = _table(spark, f"{path}/ids", _IDS, "id", buckets).where(F.col("load") <= done[-1])
    return Ledger(**tables, transactions=conform(tx, SCHEMAS["transactions"], extra=True),
                  activity=spark.read.parquet(f"{path}/activity/load={done[-1]}"),
                  ids=ids.select("id", "client_id", "n"),
                  labels_by_id=_table(spark, f"{path}/labels", _LABELS, "transaction_id", buckets)
                  .select("transaction_id", "labels", "frauds"))
