"""Exact percentiles per group without a group's values in one buffer.

A value's bucket is its sign, exponent and leading bits, so a group has at most
a few thousand buckets whatever its size.  Rows are counted per (group, value)
and then per (group, bucket), both combined before the exchange; a running
count over a group's buckets shows which ones hold the two ranks that a
percentile interpolates between; only the distinct values of these are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits of the mantissa that a bucket keeps.
BUCKET_BITS = 4


def _bucket(v: Column) -> Column:
    """Orders as ``v`` does: values of a bucket lie between those of others."""
    size = F.greatest(F.abs(v), F.lit(2.0 ** -60))
    exponent = F.floor(F.log2(size))
    lead = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << BUCKET_BITS))
    at = ((exponent + 64) * (1 << BUCKET_BITS) + lead).cast("long")
    return F.when(v < 0, -at - 1).when(v == 0, F.lit(0).cast("long")).otherwise(at + 1)


def exact_percentiles(df: DataFrame, keys: list[str], columns: dict[str, str], p: float) -> DataFrame:
    """One row a group of ``keys``: for each column of ``columns`` (to the name
    of its result) the ``p`` percentile with linear interpolation, the same
    number as ``percentile`` gives.  Nulls are left out; a column of nulls alone
    gives null."""
    names = list(columns)
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(n).cast("double").alias("_v"))
                                               for i, n in enumerate(names)])))
    counts = (long.where("_v is not null").groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_b", _bucket(F.col("_v"))))
    buckets = counts.groupBy(*keys, "_c", "_b").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys, "_c")
    upto = F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    at = (F.sum("_n").over(group) - 1) * F.lit(p)
    marked = buckets.select(*keys, "_c", "_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), at.alias("_at"))
    # Ranks floor(at) and ceil(at), from 0, lie in one or two buckets.
    held = marked.where((F.col("_before") <= F.ceil("_at")) & (F.col("_upto") > F.floor("_at"))).drop("_upto")
    inside = (counts.join(held, [*keys, "_c", "_b"])
              .withColumn("_upto", F.col("_before") + F.sum("_n").over(
                  Window.partitionBy(*keys, "_c", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))))
    found = inside.groupBy(*keys, "_c").agg(
        F.first("_at").alias("_at"),
        F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_v"))).alias("_hi"))
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_at")
    value = F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, value)).alias(columns[n]) for i, n in enumerate(names)])


def percentile_of(values: list[float], p: float) -> float:
    """The same for a list (tests)."""
    v, at = sorted(values), (len(values) - 1) * p
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
