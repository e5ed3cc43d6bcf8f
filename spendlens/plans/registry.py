"""Named query registry: each entry is ``(spark, sf_dir) -> DataFrame`` over one
ledger binding, optionally paired with the DuckDB oracle SQL of the same
result (same column names).

Timestamp columns of a registered result are rendered as ISO text with
microseconds on both sides (``ts=``), so the cross-engine comparison does not
depend on how each engine's client maps timestamps (Spark and DuckDB hand
pandas different time units); the operators themselves return timestamps."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import app_id, ensure_checkpoint_dir
from spendlens.sources.bindings import ledger as bind_ledger
from spendlens.sources.schema import Ledger


TS_TEXT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_TEXT_SQL = "%Y-%m-%d %H:%M:%S.%f"


@dataclass(frozen=True)
class Query:
    name: str
    binding: str
    ops: str
    build: Callable[[Ledger], DataFrame]
    sql: str | None
    ts: tuple[str, ...] = ()

    def oracle(self) -> str | None:
        if not self.sql or not self.ts:
            return self.sql
        rep = ", ".join(f"strftime({c}, '{TS_TEXT_SQL}') AS {c}" for c in self.ts)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) q"


QUERIES: dict[str, Query] = {}
_LEDGERS: dict[tuple[str, str, str], tuple[tuple, Ledger]] = {}


#: Set to ``true`` to store each ledger once for all queries of a session (a
#: copy of the cleaned tables, written before the first query returns); without
#: it, queries are lazy from the given tables.
MATERIALIZE_CONF = "spendlens.materializeLedger"


def materialize(spark: SparkSession, led: Ledger, name: str) -> Ledger:
    """Write the cleaned tables and the clients' activity once as Parquet in
    the cluster's shared checkpoint folder and read them back: later queries
    start from them, and a lost executor recomputes from these files.
    Transactions are sorted within files by client and date, so per-client
    filters prune row groups.  The copy goes when the session ends."""
    base = ensure_checkpoint_dir(spark)
    if base is None:  # no shared folder on this cluster: keep the lazy ledger
        return led
    root = os.path.join(base, "spendlens-ledger", app_id(spark), name)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    tables = {}
    for t, df in led.tables().items():
        if df is None:
            tables[t] = None
            continue
        path = os.path.join(root, t)
        if t == "transactions":
            df = df.sortWithinPartitions("client_id", "date")
        df.write.mode("overwrite").parquet(path)
        tables[t] = spark.read.parquet(path)
    stored = Ledger(**tables)
    path = os.path.join(root, "activity")
    stored.client_activity().write.mode("overwrite").parquet(path)
    stored.activity = spark.read.parquet(path)
    return stored


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for a query that writes and reads files: below the shared
    checkpoint folder, gone when the session ends."""
    base = ensure_checkpoint_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base.rstrip('/')}/spendlens-{what}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Bytes of input files that are meant for one partition of an exchange.
PARTITION_BYTES = 32 << 20
_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def exchanges_for(df: DataFrame) -> Iterator[None]:
    """While a query writes files made from ``df``, exchanges start with a number
    of partitions that grows with the files it reads (the session's own number
    at least), so none of them gets a fixed share of the input; adaptive
    execution merges small ones."""
    spark = df.sparkSession
    jvm, names = spark._jvm, {}
    for f in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        names.setdefault(at.getParent().toString(), set()).add(at.getName())
    total = 0
    for folder, mine in names.items():  # one listing a folder, not a call a file
        root = jvm.org.apache.hadoop.fs.Path(folder)
        found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        total += sum(x.getLen() for x in found if x.getPath().getName() in mine)
    before = spark.conf.get(_FIRST_PARTITIONS, None)
    own = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_FIRST_PARTITIONS, str(max(own, -(-total // PARTITION_BYTES))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FIRST_PARTITIONS)
        else:
            spark.conf.set(_FIRST_PARTITIONS, before)


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, time, size and number of files of each table below a folder, from
    the file system's own summaries (one call a table)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(root):
        total = fs.getContentSummary(status.getPath())
        out.append((status.getPath().getName(), status.getModificationTime(), total.getLength(), total.getFileCount()))
    return tuple(sorted(out))


def get_ledger(spark: SparkSession, sf_dir: str, binding: str) -> Ledger:
    """One Ledger per (application, data dir, binding), shared by every query of
    that binding as long as the input's files stay the same; then the tables
    are bound anew (and Spark's file listings of the folder dropped)."""
    key = (app_id(spark), sf_dir.rstrip("/"), binding)
    state = input_state(spark, key[1])
    known, led = _LEDGERS.get(key, (None, None))
    if known != state:
        if known is not None:
            spark.catalog.refreshByPath(key[1])
        led = bind_ledger(spark, sf_dir, binding)
        if spark.conf.get(MATERIALIZE_CONF, "false").lower() == "true":
            tag = hashlib.sha1(repr((key[1], state)).encode()).hexdigest()[:12]
            led = materialize(spark, led, f"{binding}-{tag}")
        _LEDGERS[key] = (state, led)
    return led


def register(name: str, binding: str, ops: str, sql: str | None = None,
             ts: tuple[str, ...] = ()):
    def deco(fn: Callable[[Ledger], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, binding, ops, fn, sql, tuple(ts))
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QUERIES[name]
    df = q.build(get_ledger(spark, sf_dir, q.binding))
    if q.ts:
        df = df.select(*[F.date_format(c, TS_TEXT_SPARK).alias(c) if c in q.ts else F.col(c)
                         for c in df.columns])
    return df


def _load_all() -> None:
    # Importing the modules fills QUERIES.
    from spendlens.plans import (q_basics, q_insights, q_kpis, q_merchants,  # noqa: F401
                                 q_rewards, q_sources, q_spending)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: (lambda spark, sf_dir, _n=n: run(_n, spark, sf_dir)) for n in QUERIES}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: q.oracle() for n, q in QUERIES.items() if q.sql}
