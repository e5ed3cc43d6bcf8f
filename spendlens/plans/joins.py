"""Plan-shape helpers shared by the operators.

* ``attach_per_client`` joins a one-row-per-client table on ``client_id``, with
  no hint: Spark broadcasts it when its measured size allows, and splits a hot
  client otherwise (adaptive skew join).
* ``may_match`` drops rows whose key cannot be in another table, before any
  exchange.
* ``top_k_per_group`` keeps the first ``k`` rows of each group in two salted
  rounds, so a hot group never lands whole in one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.sources.schema import Ledger

DEFAULT_SALT_BUCKETS = 16
SALT_BUCKETS_CONF = "spendlens.topk.saltBuckets"


def attach_per_client(ledger: Ledger, df: DataFrame, per_client: DataFrame,
                      how: str = "inner") -> DataFrame:
    """Join a table with one row per ``client_id`` to ``df`` (``inner`` or ``left``)."""
    return df.join(per_client, "client_id", how)


#: Bits of the key filter: its table has at most 2^22 / 64 = 65,536 rows of 16 bytes.
FILTER_BITS = 22


def may_match(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys`` (a hashed bitmap; none
    that is there is lost, null keys go).  The filter is built on
    the executors, one row a 64-bit word with a bit set, so at most ``2^bits / 64``
    rows are broadcast, whatever the number of keys; past about ``2^bits / 4``
    keys it lets most rows pass, at no loss but speed."""
    at = F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    on = (keys.where(F.col(key).isNotNull()).select(word.alias("__filter_word"), bit.alias("bit"))
          .groupBy("__filter_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__filter")))
    hit = df.where(F.col(key).isNotNull()).join(F.broadcast(on), word == F.col("__filter_word"))
    return hit.where(F.getbit("__filter", bit) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank", salt_buckets: int | None = DEFAULT_SALT_BUCKETS,
                    salt_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``k`` rows per ``keys`` by ``order`` (which must be a total order),
    numbered 1..k in ``rank_col``.

    Round one ranks inside ``(keys, salt)``; each map task keeps ``k`` rows per
    group and salt before the exchange, and at most ``k * salt_buckets`` rows
    per group reach the final window.  Few buckets keep the map-side limit
    tight and still spread a hot group over several tasks.
    """
    keys = list(keys)
    if salt_buckets == DEFAULT_SALT_BUCKETS:
        conf = df.sparkSession.conf.get(SALT_BUCKETS_CONF, None)
        salt_buckets = int(conf) if conf else salt_buckets
    if salt_buckets and salt_buckets > 1:
        cols = list(salt_cols) if salt_cols else [c for c in df.columns if c not in keys]
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt)
                .withColumn("_rn", F.row_number().over(w1))
                .filter(F.col("_rn") <= k)
                .drop("_salt", "_rn"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w2).cast("long"))
              .filter(F.col(rank_col) <= k))


def rank_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             rank_col: str = "rank") -> DataFrame:
    """Full ranking inside each group; only for groups of bounded size
    (categories, catalogue cards, portfolio members)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long"))
