"""Mixing sources to target weights (operator 5): Poisson replication.

A source's repetition rate is its target share of the whole volume (code
points, or rows) divided by its own volume.  Every document is repeated as
often as a Poisson variable with that mean says: the distribution is inverted
at a number in [0, 1) made from a hash of seed and id, so that a rerun or a
recomputed task draws the same.  A rate above ``SPLIT`` is drawn as a sum of
equal independent parts (exp(-rate) would be 0 at large rates).  The copies
are then dealt by a hash of id and copy number and sorted by it within
partitions, which is a global shuffle in one exchange.

Only a table of one row a source is joined, with no hint: Spark broadcasts it
if its measured size allows and else splits a hot source (adaptive skew join).

Targets: ``weights`` (source to weight; sources that it does not name get
none), or shares ``volume ** alpha``.  A null source is a source of its own.
A null id draws by a hash of the text.  A source of no volume (null and empty
texts alone) has rate 0 by code points.  Rows that repeat an id draw alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored

#: Largest mean of one Poisson draw.
SPLIT = 32.0
_UNIT = float(1 << 52)


def _uniform(*parts: Column) -> Column:
    """52 hash bits of the parts as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / _UNIT


def _cdf(mean: Column) -> Column:
    """Poisson distribution function at 0, 1, ... until it is 1 to the last bit."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def add(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(2 * mean + 60).cast("int")), start, add, lambda s: s["c"])


def source_rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text",
                 unit: str = "chars", weights: dict[str, float] | None = None, alpha: float = 0.5,
                 size: float = 1.0) -> DataFrame:
    """``(source, volume, rate)``; the mixture has ``size`` times the volume."""
    one = F.length(F.col(text_col).cast("string")) if unit == "chars" else F.lit(1)
    v = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.coalesce(F.sum(one), F.lit(0)).cast("double").alias("volume"))
    v = stored(v)
    if weights is None:
        v = v.withColumn("w", F.when(F.col("volume") > 0, F.pow("volume", F.lit(alpha))).otherwise(0.0))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        v = v.withColumn("w", F.when(F.col("volume") > 0, F.coalesce(named[F.col("source")], F.lit(0.0))).otherwise(0.0))
    total = v.agg(F.sum("volume").alias("volume"), F.sum("w").alias("w")).first()  # one row
    rate = F.lit(float(size)) * F.col("w") / F.lit(total.w) * F.lit(total.volume) / F.col("volume")
    return v.select("source", "volume", F.when(F.col("w") > 0, rate).otherwise(0.0).alias("rate"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                seed: int = 17, **targets) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in shuffled order;
    three columns are added: ``copy`` (from 0), ``n_copies``, ``shuffle_key``.
    Columns of ``docs`` with these names give way to them; the row travels as
    one struct, so no other name can clash."""
    rates = source_rates(docs, source_col=source_col, text_col=text_col, **targets)
    parts = F.greatest(F.ceil(F.col("rate") / SPLIT), F.lit(1)).cast("int")
    plan = stored(rates.where("rate > 0").select(F.col("source").alias("name"), parts.alias("parts"),
                                                 _cdf(F.col("rate") / parts).alias("cdf")))
    key = F.coalesce(docs[id_col].cast("string"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("key"),
                      docs[source_col].cast("string").alias("source"))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= _uniform(F.lit(str(seed)), j.cast("string"), F.col("key")))))
    hit = (row.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("n_copies", drawn).where("n_copies > 0")
           .select("row", "key", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy")))
    order = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "key", F.col("copy").cast("string"))), 1, 16)
    added = ("copy", "n_copies", "shuffle_key")
    out = hit.withColumn("shuffle_key", order).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
