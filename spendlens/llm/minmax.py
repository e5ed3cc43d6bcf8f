"""MinHash near-duplicates by min-max hashing (operator 12).

Documents are sets of word shingles and link when their Jaccard similarity
reaches ``threshold`` percent.

1. *Classes.*  Rows of equal sets are one class; only classes are compared.
2. *Signature.*  Each permutation (an xor and an odd multiplication of the
   64-bit shingle hash) gives two values, the minimum and the maximum over the
   set: both agree between two sets with a probability of their similarity,
   and as they are negatively correlated, the share that agrees is an unbiased
   estimate of lower variance than from as many minima.  ``bands`` bands of
   ``rows`` values are hashed to buckets, half of them of minima, half of
   maxima, from ``bands / 2 * rows`` permutations.  A pair at the threshold 0.8
   misses all 32 bands of 4 with a probability of under 1e-6.
3. *Stars.*  Each class is confirmed on full sets against one class of its
   buckets, the one it shares most of them with; connected classes get one
   label.  So a group of n near copies costs n comparisons, not n * n.
4. *Rest.*  A bucket whose classes have several labels is compared pair by
   pair, over different labels alone, if it holds at most ``heavy`` classes.
   Larger ones (texts that share a long passage, or a group of near copies that
   are rather unlike each other) are joined where they share classes, and cut
   into blocks; a task compares two blocks by the product of their incidence
   matrices and gives back a spanning set of the links between labels.  So a
   group of n classes makes n * blocks rows, and no bucket is cut short.
5. *Confirmation.*  All candidate pairs are confirmed on full sets.

Nulls and texts without words have 0 shingles, link with nothing and are kept;
fewer words than ``width`` give one shingle; repeated rows share a class; a
null id is returned with its class's component (or null) and is not kept where
another row stands for the class; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Bitmap, bitmap_of, mix, prepare, stored
from spendlens.llm.components import connected_components
from spendlens.llm.ngram_join import SEEN, _batch, _blocks, _class, _product, _roles, _sets, _sizes_fit, _verified, _wanted

_U = np.uint64


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` permutations ``x -> (x ^ a) * b`` of 64-bit numbers, ``b`` odd."""
    x = mix(np.arange(1, 2 * count + 1, dtype=_U) + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x[:count], x[count:] | _U(1)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation over a set: two rows."""
    out = np.empty((2, len(a)), _U)
    for j in range(len(a)):
        x = (s ^ a[j]) * b[j]
        out[0, j], out[1, j] = x.min(), x.max()
    return out


def _signatures(flat: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures of many sets, laid end to end: (set, minimum/maximum, permutation)."""
    out = np.empty((len(first), 2, len(a)), _U)
    for j in range(len(a)):
        x = (flat ^ a[j]) * b[j]
        out[:, 0, j] = np.minimum.reduceat(x, first)
        out[:, 1, j] = np.maximum.reduceat(x, first)
    return out


def _buckets(sig: np.ndarray, rows: int) -> np.ndarray:
    """Bucket numbers of the bands of signatures: (set, band)."""
    n, _, perms = sig.shape
    band = sig.reshape(n, 2 * perms // rows, rows)
    x = np.broadcast_to(np.arange(1, band.shape[1] + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), band.shape[:2]).copy()
    for i in range(rows):
        x = mix(x ^ band[:, :, i])
    return x


#: Shingles that are permuted at once.
HELD = 65_536


_ENTRY = "cls long, n long, bucket long"


def _banded(width: int, bands: int, rows: int, seed: int):
    """``(cls, n, bucket)`` of the classes a task meets first."""
    a, b = permutations(bands // 2 * rows, seed)

    def packed(cls, sets) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets])
        first = np.cumsum(size) - size
        at = _buckets(_signatures(np.concatenate(sets), first, a, b), rows)
        return _batch(cls=np.repeat(np.array(cls, np.int64), bands), n=np.repeat(size, bands), bucket=at.ravel().view(np.int64))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            cls, sets, held = [], [], 0
            for _, s in _sets(batch.column(0), width):
                if not len(s) or (c := _class(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                cls.append(c)
                sets.append(s)
                held += len(s)
                if held > HELD:
                    yield packed(cls, sets)
                    cls, sets, held = [], [], 0
            if cls:
                yield packed(cls, sets)
    return run


def _classes(width: int):
    """``(id, n, cls)`` of every row."""
    def run(batches):
        for b in batches:
            n, cls = [], []
            for _, s in _sets(b.column(1), width):
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
            yield _batch(id=b.column(0), n=pa.array(n, pa.int64()), cls=pa.array(cls, pa.int64()))
    return run


def _full_sets(text: DataFrame, width: int, classes: DataFrame) -> DataFrame:
    """``(cls, s)``: the sets of the classes in a column ``cls`` and of a few
    others; a class may come several times."""
    return text.mapInArrow(_wanted(width, [bitmap_of(classes, "cls", 23)]), "cls long, s array<long>, use int").select("cls", "s")


def _pairs(rows: DataFrame, t: int) -> DataFrame:
    """Pairs ``(a, b)`` of classes that meet in a bucket, neither of one label
    nor of one cell (whose blocks are compared anyhow)."""
    x, y = (rows.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "label", "cell")]) for side in "xy")
    return (x.join(y, "bucket").where((F.col("x_cls") < F.col("y_cls")) & (F.col("x_label") != F.col("y_label"))
                                      & (F.col("x_cell") != F.col("y_cell")) & _sizes_fit("x_n", "y_n", t))
            .select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct())


def _shared(on: Bitmap):
    """Rows whose bucket is in a bitmap (and a few others)."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(on.has(b.column("bucket").to_numpy().view(_U))))
    return run


def minmax_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4,
                      threshold: int = 80, bands: int = 32, rows: int = 4, seed: int = 12, heavy: int = 64) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``; the
    threshold is in percent.  See the module text for the method."""
    if bands % 2 or bands < 2 or rows < 1:
        raise ValueError("bands come in halves: minima and maxima")
    spark, t = docs.sparkSession, threshold
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    text = src.select("text")
    sig = stored(src.mapInArrow(_classes(width), "id long, n long, cls long"))

    # Buckets of two classes or more, and each one's first class (counted
    # before the shuffle, so a bucket of a third of all rows is no hot key).
    # Rows of other buckets stay where they are.
    every = stored(text.mapInArrow(_banded(width, bands, rows, seed), _ENTRY))
    met = stored(every.groupBy("bucket").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last"))
                 .where("pivot <> last").select("bucket", "pivot"))
    shared = stored(every.mapInArrow(_shared(bitmap_of(met, "bucket", 24)), _ENTRY).join(met, "bucket"))
    stars = (shared.where(F.col("cls") != F.col("pivot"))
             .groupBy(F.col("cls").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("c"))
             .groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b"))
    roles = stored(_roles(stored(stars)))
    sure = stored(_verified(_full_sets(text, width, roles), roles, t))
    label = connected_components(sure)

    # Buckets that still hold several labels.
    marked = (shared.select("bucket", "cls", "n").join(label.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("label", F.coalesce("label", "cls")))
    several = marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    marked = marked.join(several, "bucket").distinct()
    size = marked.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cls").alias("pivot"))
    marked = stored(marked.join(size, "bucket"))
    crowd = marked.where(F.col("size") > heavy)
    cell = (connected_components(crowd.select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
            .select(F.col("node").alias("cls"), F.col("label").alias("cell")))
    dealt = stored(_blocks(cell, label))
    few = marked.where(F.col("size") <= heavy).join(cell, "cls", "left").withColumn("cell", F.coalesce("cell", "cls"))
    roles = stored(_roles(stored(_pairs(few, t))))
    sets = stored(text.mapInArrow(_wanted(width, [bitmap_of(x, "cls", 23) for x in (roles, dealt)]),
                                  "cls long, s array<long>, use int"))
    found = (dealt.join(sets.where("use >= 2").select("cls", "s"), "cls").groupBy("pair")
             .applyInPandas(_product(t), "a long, b long"))
    label = connected_components(sure.unionByName(_verified(sets.where("use % 2 = 1"), roles, t)).unionByName(found))

    # From classes to documents: the smallest id of each component.
    classes = sig.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"))
    lab = stored(classes.join(label.withColumnRenamed("node", "cls"), "cls", "left"))
    roots = lab.where("label is not null").groupBy("label").agg(F.min("low").alias("root"))
    owner = lab.join(roots, "label", "left").select("cls", F.coalesce("root", "low").alias("component_id"))
    out = sig.where("n > 0").join(owner, "cls").select("id", F.col("n").alias("n_shingles"), "component_id")
    lone = sig.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull())
    return out.unionByName(lone).withColumn("kept", kept).withColumnRenamed("id", id_col)
