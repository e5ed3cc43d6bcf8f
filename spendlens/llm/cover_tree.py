"""Hard-negative mining (operator 13): cover trees over norm-augmented vectors.

For an *anchor* and each of its *positives* (the ``positives`` rows of its label
with the greatest inner products) the ``negatives`` rows of other labels are
wanted whose score lies in a window below the positive's,
``[least percent of it, the positive's score]``.

1. *Index.*  Rows are dealt by a hash of the id to blocks of about ``BLOCK``.
   The vectors of a block are lifted to one sphere, ``x' = (x, sqrt(M^2 - |x|^2))``
   with ``M`` the block's greatest norm; then ``<q, x> = |q| M cos(q', x')`` for
   ``q' = (q, 0)``, and near in angle means great in inner product.  A cover
   tree is built on the lifted vectors: the centres of a level are farther
   apart than its radius, which falls by ``BASE`` a level, and cover the node's
   vectors.  Each node keeps the true covering radius of what is below it.  A
   node that the next radius would only break into single vectors is a leaf.
   The trees are stored, one row a block; every row is in one.
2. *Bounds.*  With the angle ``a`` between ``q'`` and a node's centre and ``r``
   the angle of its radius, every inner product below the node lies between
   ``|q| M cos(a + r)`` and ``|q| M cos(a - r)``.
3. *Descent.*  Best first by the upper bound (at most the window's top); a node
   outside the window, or under the worst score still kept, is skipped with all
   below it.  Leaves are verified exactly on the whole-numbered vectors.
4. *Rounds.*  Anchors go through the index in rounds of about ``ROUND`` rows,
   the only thing broadcast, so its size is bounded.  A task keeps the best
   rows of each anchor (then of each window) over its blocks; ranks are taken
   over all tasks.

Rows with a null id, label or vector, or a null, infinite or NaN component take
no part; of rows that repeat an id one is kept (smallest label, then vector);
shorter vectors are padded with zeros; an empty vector scores 0; other columns
are not looked at.  Scores are exact while below 2^53.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import prepare, stored

#: Rows of a block, and of a leaf that is not split further.
BLOCK, LEAF = 8192, 32
#: The radius falls by this a level.
BASE = 1.3
#: Anchors that are broadcast at once.
ROUND = 16_384


def _matrix(vectors: list[np.ndarray], width: int | None = None) -> np.ndarray:
    out = np.zeros((len(vectors), width or max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class CoverTree:
    """Cover tree of the rows of ``x`` (whole numbers as doubles)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        norm2 = (x * x).sum(1)
        self.norm = math.sqrt(norm2.max()) if len(x) else 0.0
        lifted = np.column_stack([x, np.sqrt(np.maximum(self.norm ** 2 - norm2, 0.0))])
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.below: list = []  # child nodes, or the rows of a leaf
        self.leaf: list[bool] = []
        if len(x):
            rows = np.arange(len(x))
            d = np.sqrt(np.maximum(((lifted - lifted[0]) ** 2).sum(1), 0.0))
            self._node(lifted, rows, d, float(d.max()))

    def _node(self, y: np.ndarray, rows: np.ndarray, d: np.ndarray, r: float) -> int:
        """Make the node with centre ``rows[0]``; ``d`` are distances to it."""
        me = len(self.centre)
        self.centre.append(int(rows[0]))
        reach = float(d.max())
        self.radius.append(reach)
        self.leaf.append(True)
        self.below.append(rows)
        if len(rows) <= LEAF or reach == 0.0:
            return me
        while r > reach / BASE:
            r /= BASE
        nets = []
        rest, far = rows, d
        while len(rest):
            near = far <= r
            near[0] = True
            nets.append((rest[near], far[near]))
            rest = rest[~near]
            if len(nets) * 4 > len(rows):
                return me  # single vectors: verified here
            if len(rest):
                far = np.sqrt(((y[rest] - y[rest[0]]) ** 2).sum(1))
        self.leaf[me] = False
        self.below[me] = [self._node(y, *net, r) for net in nets]
        return me

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product below each node, for each row of ``q``."""
        size = np.sqrt((q * q).sum(1))[:, None] * self.norm
        dot = q @ self.x[self.centre].T
        cos = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
        angle = np.arccos(np.clip(cos, -1, 1))
        reach = 2 * np.arcsin(np.clip(np.array(self.radius) / (2 * self.norm), 0, 1)) if self.norm else np.zeros(len(self.centre))
        slack = 1e-6 * size + 1e-3
        return (size * np.cos(np.minimum(angle + reach, np.pi)) - slack,
                size * np.cos(np.maximum(angle - reach, 0)) + slack)

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, ok: np.ndarray, least: float, most: float,
               best: list[tuple], k: int) -> None:
        """Bring ``best``, a heap of ``(score, -id)`` of the ``k`` first rows,
        up to date with the rows of ``ok`` that score in ``[least, most]``."""
        if not self.centre:
            return
        heap = [(-min(high[0], most), 0)]
        while heap:
            up, node = heapq.heappop(heap)
            floor = best[0][0] if len(best) == k else least
            if -up < floor:
                return
            if high[node] < max(floor, least) or low[node] > most:
                continue
            if not self.leaf[node]:
                for c in self.below[node]:
                    if high[c] >= max(floor, least) and low[c] <= most:
                        heapq.heappush(heap, (-min(high[c], most), c))
                continue
            rows = self.below[node]
            rows = rows[ok[rows]]
            score = self.x[rows] @ q
            hit = (score >= max(floor, least)) & (score <= most)
            for s, i in zip(score[hit].tolist(), self.ids[rows[hit]].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one packed tree a block."""
    def tree(rows) -> pa.RecordBatch:
        ids, labels, vectors = zip(*rows, strict=True)
        t = CoverTree(np.array(ids, np.int64), np.array(labels, np.int64), _matrix(vectors))
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(t, 5), 1)], pa.binary())], ["tree"])

    now, held = None, []
    for b in batches:
        for block, i, label, v in zip(*[c.to_pylist() for c in b.columns[:3]], b.column(3), strict=True):
            if block != now and held:
                yield tree(held)
                held = []
            now = block
            held.append((i, label, v.values.to_numpy(zero_copy_only=False).astype(np.float64)))
    if held:
        yield tree(held)


def _search(anchors, positives: int, negatives: int, least: int):
    """First pass (``anchors`` without scores): the best rows of an anchor's
    label.  Second pass: the best rows of its windows."""
    def run(batches):
        ids, labels, matrix, scores = anchors.value
        best: dict[tuple, list] = {}
        for b in batches:
            for packed in b.column(0).to_pylist():
                t: CoverTree = pickle.loads(zlib.decompress(packed))
                width = max(matrix.shape[1], t.x.shape[1])
                q = _widen(matrix, width)
                t.x = _widen(t.x, width)
                for lo in range(0, len(q), 256):
                    part = q[lo:lo + 256]
                    low, high = t.bounds(part)
                    for j in range(len(part)):
                        a = lo + j
                        if scores is None:
                            t.search(part[j], low[j], high[j], (t.labels == labels[a]) & (t.ids != ids[a]),
                                     -math.inf, math.inf, best.setdefault((a, 0), []), positives)
                            continue
                        other = t.labels != labels[a]
                        for s in scores[a]:
                            if s >= 0:
                                t.search(part[j], low[j], high[j], other, -(-least * s // 100), s,
                                         best.setdefault((a, s), []), negatives)
        rows = [(int(ids[a]), int(s), int(score), -i) for (a, s), heap in best.items() for score, i in heap]
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows[lo:lo + 50_000], strict=True)], ["anchor", "top", "score", "id"])
    return run


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def hard_negatives(rows: DataFrame, is_anchor, *, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", label=None, scale: int = 256, positives: int = 5, negatives: int = 5,
                   least: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``.  ``is_anchor`` is a condition over ``id``; ``label`` an
    expression over ``id`` and ``label`` that replaces the label."""
    spark = rows.sparkSession
    prepare(spark)
    v = F.col(vector_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    src = (rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).where(fine)
           .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v")))
    if label is not None:
        src = src.withColumn("label", label)
    src = stored(src.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    n = src.count()
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK))))
    trees = stored(src.select(block.alias("block"), "id", "label", "v").repartition("block").sortWithinPartitions("block")
                   .mapInArrow(_index, "tree binary"))
    asked = src.where(is_anchor)
    rounds = max(1, -(-2 * asked.count() // ROUND))
    found = []
    for r in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(rounds)) == r).select("id", "label", "v").toArrow()
        if mine.num_rows:
            found.append(_round(spark, trees, mine, positives, negatives, least))
    if not found:
        return spark.createDataFrame([], _OUT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _round(spark, trees: DataFrame, mine: pa.Table, positives: int, negatives: int, least: int) -> DataFrame:
    """The rows of one round of anchors, stored."""
    ids = mine.column("id").to_numpy()
    labels = mine.column("label").to_numpy()
    matrix = _matrix([np.array(v, np.float64) for v in mine.column("v").to_pylist()])
    schema = "anchor long, top long, score long, id long"

    def first(df: DataFrame, k: int, *key: str) -> DataFrame:
        return (df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id")))
                .where(F.col("rank") <= k))

    sent = spark.sparkContext.broadcast((ids, labels, matrix, None))
    near = stored(first(trees.mapInArrow(_search(sent, positives, negatives, least), schema), positives, "anchor")
                  .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # At most ``positives`` rows an anchor of the round.
    tops: dict[int, list[int]] = {}
    for a, s in zip(*(c.to_pylist() for c in near.select("anchor", "positive_score").distinct().toArrow().columns), strict=True):
        tops.setdefault(a, []).append(s)
    sent.destroy()
    sent = spark.sparkContext.broadcast((ids, labels, matrix, [tops.get(int(i), []) for i in ids]))
    windows = first(trees.mapInArrow(_search(sent, positives, negatives, least), schema), negatives, "anchor", "top")
    out = (near.join(windows.withColumnRenamed("anchor", "w_anchor"),
                     (F.col("anchor") == F.col("w_anchor")) & (F.col("positive_score") == F.col("top")))
           .select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                   F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return stored(out)
