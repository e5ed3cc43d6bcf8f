"""Quality classifier by co-training (operator 3).

Two classifiers see different views of a document: its text content (hashed
words, endings and shapes of words, averaged over the text) and its page
metadata (source, language, length, layout of lines).  Both are logistic
regressions, first fitted on labelled rows.  In every round each one labels all
unlabelled rows, on the executors, and the rows it is most sure of (a top-k of
each class over the whole table) go to the other's training set as
pseudo-labels.  In the end each view is calibrated on labelled
rows that no round trained on (Platt scaling), and the calibrated views are
combined by a logistic regression on the same rows.

Training takes at most ``labelled`` labelled rows (the smallest by a hash of
the id; a documented bound) and, in a round, ``share`` of their number as
pseudo-labels from each view; rows of the held-out fold get none.  Of rows that
repeat an id the smallest (text, metadata) counts.  Every row is scored, over
its whole text; a task computes each distinct word's logit once.

Null or empty texts are scored by the biases and the metadata; null metadata
is a value of its own; columns that ``docs`` lacks are left out.  Of several
labels of an id the lowest counts.  Without labels every score is 0.5 and
every row is kept.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import PIECE, prepare, chunks, crc_mod, mix, stored, words

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """``confident``: lowest calibrated probability of a pseudo-label;
    ``share``: most pseudo-labels a round, as a share of the labelled rows."""

    bits: int = 16
    meta_bits: int = 12
    labelled: int = 4000
    rounds: int = 3
    confident: float = 0.95
    share: float = 0.25
    steps: int = 120
    rate: float = 0.3
    l2: float = 1e-4
    seed: int = 5


#: Classes of bytes in a word's shape: other ASCII, lower, upper, digit, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Three buckets for each word: itself, its last bytes, its shape."""
    size = end - start
    counts = np.stack([np.concatenate([[0], np.cumsum(_CLASS[buf] == k)]) for k in range(5)])
    n = counts[:, end] - counts[:, start]
    share = np.minimum(4, 4 * n // np.maximum(size, 1))
    shape = (((share[0] * 5 + share[2]) * 5 + share[3]) * 5 + _CLASS[buf[start]]) * 5 + _CLASS[buf[end - 1]]
    tail = buf[end - 1].astype(_U) + (buf[np.maximum(start, end - 2)].astype(_U) << _U(8))
    x = np.stack([mix(h), mix(tail + _U(1 << 40)), mix(shape.astype(_U) * _U(64) + np.minimum(size, 40).astype(_U) // _U(4) + _U(2 << 40))])
    return (x >> _U(64 - bits)).astype(np.int64)


def _text_view(buf, offs, bits: int):
    """Words of the texts and, for the distinct ones, their features."""
    w = words(buf, offs)
    u, first, of = np.unique(w.h, return_index=True, return_inverse=True)
    f = word_features(buf, w.start[first], w.end[first], u, bits) if len(u) else np.zeros((3, 0), np.int64)
    return w, of, f


def meta_features(buf: np.ndarray, offs: np.ndarray, n_words: np.ndarray, meta: list[list], bits: int) -> np.ndarray:
    """Buckets of the metadata of each text: given columns, length and layout."""
    n = len(offs) - 1
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = lines[offs[1:]] - lines[offs[:-1]] + 1
    cols = [np.array([0 if v is None else (zlib.crc32(v.encode("utf-8", "surrogatepass")) + 1) for v in c], np.int64) for c in meta]
    cols += [np.log2(np.diff(offs) + 1.0).astype(np.int64), np.log2(lines).astype(np.int64),
             (2 * np.log2(n_words / lines + 1.0)).astype(np.int64)]
    out = [mix(c.astype(_U) + (_U(i + 1) << _U(48))) for i, c in enumerate(cols)]
    return np.stack([(x >> _U(64 - bits)).astype(np.int64) for x in out], 1) if n else np.zeros((0, len(out)), np.int64)


def _views(p: Params, given: list[str], kept: list[str]):
    """For each row: columns ``kept``, text buckets with shares, and metadata
    buckets."""
    def run(batches):
        for b in batches:
            ids, shares, meta = [], [], []
            own = [b.column(c).to_pylist() for c in given]
            for first, end, buf, offs in chunks(b.column("text")):
                w, of, f = _text_view(buf, offs, p.bits)
                at = w.bounds()
                meta += meta_features(buf, offs, np.diff(at), [c[first:end] for c in own], p.meta_bits).tolist()
                for i in range(w.n_docs):
                    x, n = np.unique(f[:, of[at[i]:at[i + 1]]], return_counts=True)
                    ids.append(x.astype(np.int32))
                    shares.append((n / max(1, at[i + 1] - at[i])).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], b.column("o"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(shares, pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int32()))],
                [*kept, "o", "ids", "shares", "meta"])
    return run


class Sparse:
    """Rows of (column, value) pairs for a logistic regression."""

    def __init__(self, ids: list, values: list, width: int):
        self.size = np.array([len(x) for x in ids])
        self.row = np.repeat(np.arange(len(ids)), self.size)
        self.col = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
        self.val = np.concatenate(values).astype(np.float64) if values else np.empty(0)
        self.n, self.width = len(ids), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * r[self.row], minlength=self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: Sparse, use: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias fitted on the rows with weight ``use`` by Adam; both
    classes weigh as much as their rows."""
    w = np.zeros(x.width)
    rate_1 = np.clip((use * y).sum() / max(use.sum(), 1), 1e-3, 1 - 1e-3)
    b = float(np.log(rate_1 / (1 - rate_1)))
    m, v, mb, vb = np.zeros(x.width), np.zeros(x.width), 0.0, 0.0
    total = max(use.sum(), 1)
    for t in range(1, p.steps + 1):
        r = (sigmoid(x.times(w) + b) - y) * use / total
        g, gb = x.back(r) + p.l2 * w, r.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        fix = p.rate * (1 - 0.99 ** t) ** 0.5 / (1 - 0.9 ** t)
        w -= fix * m / (np.sqrt(v) + 1e-5)
        b -= 0.1 * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of ``y`` on the columns of ``z``
    and a constant, by damped Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones(len(y))])
    c = np.zeros(x.shape[1])
    c[:-1] = 1 / max(1, x.shape[1] - 1)
    for _ in range(50):
        q = sigmoid(x @ c)
        g = x.T @ (q - y) + 1e-2 * c
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return c


@dataclass
class Model:
    text_weights: np.ndarray
    text_bias: float
    meta_weights: np.ndarray
    meta_bias: float
    text_scale: np.ndarray
    meta_scale: np.ndarray
    combined: np.ndarray
    params: Params
    given: list[str]
    n_pseudo: int = 0


class CoTraining:
    """The two training sets: rows of known labels, and pseudo-labels that come
    in round by round."""

    def __init__(self, table: pa.Table, p: Params, given: list[str]):
        self.p, self.given = p, given
        rows = table.sort_by("o").to_pydict()
        self.known = len(rows["y"])
        self.y = np.array(rows["y"], np.float64)
        self.rows = [rows["ids"], rows["shares"], rows["meta"]]
        rng = np.random.default_rng(p.seed)
        held = rng.random(self.known) < 0.25
        if held.sum() < 8 or len(set(self.y[~held])) < 2:
            held[:] = True
        self.held = held
        own = ~held if not held.all() else held
        self.use = [own.astype(float) for _ in range(2)]
        self.label = [np.where(own, self.y, 0.0) for _ in range(2)]
        #: Pseudo-labels of a class that a view gives in a round.
        self.most = max(1, int(p.share * own.sum() / 2))

    def add(self, table: pa.Table) -> None:
        """Rows with pseudo-labels for a view: ``view``, ``y`` and features."""
        rows = table.sort_by([("view", "ascending"), ("o", "ascending")]).to_pydict()
        for mine, more in zip(self.rows, (rows["ids"], rows["shares"], rows["meta"]), strict=True):
            mine += more
        view, y = np.array(rows["view"], np.int64), np.array(rows["y"], np.float64)
        for k in range(2):
            self.use[k] = np.append(self.use[k], (view == k).astype(float))
            self.label[k] = np.append(self.label[k], np.where(view == k, y, 0.0))

    def fit(self) -> Model:
        p, held = self.p, np.flatnonzero(self.held)
        if not self.known:
            return Model(np.zeros(1 << p.bits), 0.0, np.zeros(1 << p.meta_bits), 0.0, np.array([1.0, 0]),
                         np.array([1.0, 0]), np.array([0.5, 0.5, 0]), p, self.given)
        ids, shares, meta = self.rows
        views = [Sparse([np.asarray(x, np.int64) for x in ids], [np.asarray(x) for x in shares], 1 << p.bits),
                 Sparse([np.asarray(x, np.int64) for x in meta], [np.ones(len(x)) for x in meta], 1 << p.meta_bits)]
        fits = [logistic(x, self.use[k], self.label[k], p) for k, x in enumerate(views)]
        z = [(x.times(w) + b)[held] for x, (w, b) in zip(views, fits, strict=True)]
        scale = [platt(v[:, None], self.y[held]) for v in z]
        calibrated = np.column_stack([s[0] * v + s[1] for s, v in zip(scale, z, strict=True)])
        return Model(fits[0][0], fits[0][1], fits[1][0], fits[1][1], scale[0], scale[1],
                     platt(calibrated, self.y[held]), p, self.given, len(ids) - self.known)


def _source(docs: DataFrame, id_col: str, text_col: str, given: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).cast("string").alias(c) for c in given])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", meta_cols: tuple[str, ...] = ("source", "lang"), held_out_mod: int | None = 5,
          params: Params | None = None) -> Model:
    p = params or Params()
    prepare(docs.sparkSession)
    given = [c for c in meta_cols if c in docs.columns]
    src = _source(docs, id_col, text_col, given).where("id is not null")
    y = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
         .agg(F.min(label_col).cast("double").alias("y")))
    fold = crc_mod("id", held_out_mod) != 0 if held_out_mod else F.lit(True)
    y = stored(y.where(fold))
    own = y.join(src.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(p.labelled)
    state = CoTraining(_features(src, own, p, given, "y double"), p, given)
    if not state.known:
        return state.fit()
    # Rows without a label, by id: only those of labelled ids are turned down.
    free = src.where(fold).join(y.select("id"), "id", "left_anti")
    taken: DataFrame | None = None
    for _ in range(p.rounds):
        sure = stored(free.mapInArrow(_surest(state.fit(), state.most), f"id {src.schema['id'].dataType.simpleString()}, {_SURE}"))
        pick = None
        for view in range(2):
            for label in range(2):
                of = sure.where((F.col("view") == view) & (F.col("y") == label))
                of = of.groupBy("id", "view", "y").agg(F.max("sure").alias("sure"))
                if taken is not None:  # a bounded table: all pseudo-labels so far
                    of = of.join(F.broadcast(taken.where(F.col("view") == view)), "id", "left_anti")
                of = of.orderBy(F.desc("sure"), F.xxhash64("id"), "id").limit(state.most)
                pick = of if pick is None else pick.unionByName(of)
        pick = stored(pick.select("id", "view", F.col("y").cast("double").alias("y")))
        if pick.isEmpty():
            break
        taken = pick if taken is None else taken.unionByName(pick)
        state.add(_features(src, pick, p, given, "view int, y double"))
    return state.fit()


def _features(src: DataFrame, rows: DataFrame, p: Params, given: list[str], kept: str) -> pa.Table:
    """Columns ``kept`` of ``rows``, a bounded table, and the features of their
    ids, one row of ``src`` for each."""
    names = [c.split(" ")[0] for c in kept.split(", ")]
    ids = src.join(F.broadcast(rows.select("id").distinct()), "id", "left_semi")
    one = ids.groupBy("id").agg(F.min(F.struct("text", *given)).alias("r")).select("id", "r.*")
    return (one.join(rows, "id").select(*names, F.xxhash64("id").alias("o"), "text", *given)
            .mapInArrow(_views(p, given, names), f"{kept}, o long, ids array<int>, shares array<float>, meta array<int>").toArrow())


#: ``view`` is the view that learns from the row, the other one is ``sure``.
_SURE = "view int, y int, sure double"


def _surest(m: Model, most: int):
    """The ``most`` rows of a task, for each view and class, that the other
    view is surest of."""
    p = m.params

    def run(batches):
        best: dict[tuple[int, int], dict] = {(v, y): {} for v in range(2) for y in range(2)}
        for b in batches:
            ids = b.column("id").to_pylist()
            t, d, _ = _probabilities(m, b)
            for view, q in ((1, sigmoid(t)), (0, sigmoid(d))):
                for y, sure in ((1, q), (0, 1 - q)):
                    of = best[view, y]
                    at = np.flatnonzero(sure >= p.confident)
                    for i in at[np.argsort(-sure[at], kind="stable")][:most].tolist():
                        of[ids[i]] = max(of.get(ids[i], 0.0), float(sure[i]))
                    if len(of) > 2 * most:
                        best[view, y] = dict(sorted(of.items(), key=_order)[:most])
        rows = [(i, v, y, s) for (v, y), of in best.items() for i, s in sorted(of.items(), key=_order)[:most]]
        if rows:
            kind = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (kind, pa.int32(), pa.int32(), pa.float64()), strict=True)], ["id", "view", "y", "sure"])
    return run


def _order(item):
    """Surest first; ties by a hash of the id, so every id has the same chance."""
    return -item[1], zlib.crc32(str(item[0]).encode("utf-8", "surrogatepass")), str(item[0])


_SCORES = "score double, text_score double, meta_score double"


def _probabilities(m: Model, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated logits of both views and of their combination."""
    p = m.params
    own = [b.column(c).to_pylist() for c in m.given]
    zt, zm = [np.empty(0)], [np.empty(0)]
    for first, end, buf, offs in chunks(b.column("text"), 2 * PIECE):
        w, of, f = _text_view(buf, offs, p.bits)
        count = np.bincount(w.doc, minlength=w.n_docs)
        logit = m.text_weights[f].sum(0)
        zt.append(np.bincount(w.doc, weights=logit[of], minlength=w.n_docs) / np.maximum(count, 1) + m.text_bias)
        x = meta_features(buf, offs, count, [c[first:end] for c in own], p.meta_bits)
        zm.append(m.meta_weights[x].sum(1) + m.meta_bias)
    t = m.text_scale[0] * np.concatenate(zt) + m.text_scale[1]
    d = m.meta_scale[0] * np.concatenate(zm) + m.meta_scale[1]
    return t, d, m.combined[0] * t + m.combined[1] * d + m.combined[2]


def _score(m: Model):
    def run(batches):
        for b in batches:
            t, d, both = _probabilities(m, b)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(sigmoid(v), pa.float64()) for v in (both, t, d))],
                ["id", "score", "text_score", "meta_score"])
    return run


def quality_scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
                   held_out_mod: int = 5, threshold: float = 0.5) -> DataFrame:
    """id, ``held_out``, combined score (probability of good quality), the
    calibrated scores of both views, ``predicted`` and ``kept`` of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    s = _source(docs, id_col, text_col, model.given).mapInArrow(_score(model), f"id {kind}, {_SCORES}")
    return s.select(F.col("id").alias(id_col), F.coalesce(crc_mod("id", held_out_mod) == 0, F.lit(False)).alias("held_out"),
                    "score", "text_score", "meta_score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                    (F.col("score") >= threshold).alias("kept"))
