"""Toxicity (operator 8): a bag of subword embeddings, averaged, into a linear
softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams
(over UTF-8 bytes, with word ends) and of the word itself, so a misspelling
that was never seen shares most vectors with the word it comes from.  A text's
vector is the mean over its words; embeddings and softmax are fitted together
by Adam on mini-batches.  Training takes at most ``sample`` labelled rows (the
smallest by a hash of the id, a documented bound); every row is scored, over
its whole text.  Since both layers are linear, a text's logit is the mean of
its words' logits, which a task computes once for each distinct word.

Null and empty texts get the score of the bias alone.  Several labels of an id
count as toxic if one is; null labels and labels without a document are left
out.  Without any label every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import PIECE, prepare, chunks, crc_mod, mix, words

_U = np.uint64
_WORD_SALT = _U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Params:
    """Buckets are ``2**bits`` (16 at most); n-grams have ``shortest`` to ``longest`` bytes."""

    bits: int = 16
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    sample: int = 6000
    epochs: int = 6
    batch: int = 64
    rate: float = 1.0
    damping: float = 3e-5
    seed: int = 7


@dataclass
class Model:
    """``bucket`` holds each bucket's logit (vector times softmax row)."""

    bucket: np.ndarray
    bias: float
    params: Params


def subwords(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, p: Params):
    """Bucket numbers of all words' subwords, and where each word's begin."""
    size = (end - start).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size + 2)])
    own = np.full(first[-1], ord("<"), np.uint8)
    at = np.repeat(first[:-1] + 1, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    own[at] = buf[np.repeat(start, size) + (at - np.repeat(first[:-1] + 1, size))] | _UPPER[
        buf[np.repeat(start, size) + (at - np.repeat(first[:-1] + 1, size))]]
    own[first[1:] - 1] = ord(">")
    word = np.repeat(np.arange(len(size)), size + 2)
    owner, bucket = [np.arange(len(size))], [mix(h ^ _WORD_SALT)]
    v = own.astype(_U)
    run = np.zeros(len(own), _U)
    for k in range(1, p.longest + 1):
        n = len(own) - k + 1
        if n <= 0:
            break
        run = run[:n] * _U(257) + v[k - 1:k - 1 + n] + _U(1)
        if k >= p.shortest:
            inside = word[:n] == word[k - 1:k - 1 + n]
            owner.append(word[:n][inside])
            bucket.append(mix(run[inside] + (_U(k) << _U(56))))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(bucket)[order] >> _U(64 - p.bits)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(size)))


_UPPER = np.zeros(256, np.uint8)
_UPPER[ord("A"):ord("Z") + 1] = 32


def _bags(p: Params):
    """For each text its distinct subword buckets and their shares of its
    vector (every word counts 1/words, every subword 1/subwords of its word)."""
    def run(batches):
        for b in batches:
            ids, shares, scale = [], [], []
            for _, _, buf, offs in chunks(b.column(1)):
                w = words(buf, offs)
                at = w.bounds()
                for i in range(w.n_docs):
                    s = slice(at[i], at[i + 1])
                    u, first, times = np.unique(w.h[s], return_index=True, return_counts=True)
                    first = first + at[i]
                    x, begin = subwords(buf, w.start[first], w.end[first], u, p)
                    n = np.diff(np.append(begin, len(x)))
                    share = np.repeat(times / max(1, times.sum()) / np.maximum(n, 1), n)
                    own, of = np.unique(x, return_inverse=True)
                    each = np.bincount(of, weights=share, minlength=len(own))
                    scale.append(float(each.max(initial=0.0)) / 65535)
                    # Two bytes each: the sample meets on the driver.
                    ids.append(own.astype(np.uint16).view(np.int16))
                    shares.append((np.rint(each / (scale[-1] or 1)) - 32768).astype(np.int16))
            shorts = pa.list_(pa.int16())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scale, pa.float64()), pa.array(ids, shorts), pa.array(shares, shorts)],
                ["y", "scale", "ids", "shares"])
    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  held_out_mod: int | None, sample: int) -> DataFrame:
    """``(y, text)`` of at most ``sample`` labelled documents, outside the
    held-out fold, taken by a hash of the id; of rows that repeat an id the
    smallest text counts."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out_mod:
        y = y.where(crc_mod(id_col, held_out_mod) != 0)
    y = y.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    y = y.join(own.select("_id").distinct(), "_id", "left_semi")
    y = y.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # ``sample`` rows at most.
    return own.join(F.broadcast(y), "_id").groupBy("_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out_mod: int | None = 5, params: Params | None = None) -> Model:
    p = params or Params()
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, held_out_mod, p.sample)
    bags = rows.mapInArrow(_bags(p), "y double, scale double, ids array<short>, shares array<short>")
    # The sample is bounded, so one task holds it; the driver gets the weights alone.
    got = bags.repartition(1).mapInArrow(_fitted(p), "bucket binary, bias double").first()
    if got is None:
        return Model(np.zeros(1 << p.bits, np.float32), -np.inf, p)
    return Model(np.frombuffer(got.bucket, np.float32), got.bias, p)


def _fitted(p: Params):
    def run(batches):
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            m = fit(table, p)
            yield pa.RecordBatch.from_arrays([pa.array([m.bucket.astype(np.float32).tobytes()], pa.binary()),
                                              pa.array([m.bias], pa.float64())], ["bucket", "bias"])
    return run


def fit(table: pa.Table, p: Params) -> Model:
    """Joint training on the collected bags (bounded by ``p.sample`` rows)."""
    n, buckets = table.num_rows, 1 << p.bits
    if not n:
        return Model(np.zeros(buckets, np.float32), -np.inf, p)
    y = table.column("y").to_numpy().astype(np.int64)
    ids = [x.view(np.uint16) for x in _lists(table.column("ids"))]
    shares, scale = _lists(table.column("shares")), table.column("scale").to_numpy().astype(np.float32)
    # Rows come back in any order: a fixed order makes the fit repeatable.
    rows = np.lexsort((y, [int(x.sum(dtype=np.int64)) for x in ids]))
    rng = np.random.default_rng(p.seed)
    rate_1 = float(np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2)))
    var = [rng.normal(0, 0.1, (buckets, p.dim)).astype(np.float32),
           rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32),
           np.log(np.array([1 - rate_1, rate_1], np.float32))]
    m, v = [np.zeros_like(x) for x in var], [np.zeros_like(x) for x in var]
    step = 0
    bucket, bias, taken = np.zeros(buckets, np.float32), 0.0, 0
    for epoch in range(p.epochs):
        order = rows[rng.permutation(n)]
        rate = np.float32(p.rate * (1 - 0.9 * epoch / p.epochs))
        for lo in range(0, n, p.batch):
            take = order[lo:lo + p.batch]
            bag = np.zeros((len(take), buckets), np.float32)
            for i, k in enumerate(take):
                bag[i, ids[k]] = (shares[k].astype(np.float32) + np.float32(32768)) * scale[k]
            e, w, b = var
            hidden = bag @ e
            logit = hidden @ w + b
            q = np.exp(logit - logit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(take)), y[take]] -= 1
            q /= len(take)
            step += 1
            for x, mx, vx, g in zip(var, m, v, (bag.T @ (q @ w.T), hidden.T @ q, q.sum(0)), strict=True):
                mx += np.float32(0.1) * (g - mx)
                vx += np.float32(0.01) * (g * g - vx)
                x -= rate * mx / np.float32(1 - 0.9 ** step) / (np.sqrt(vx / np.float32(1 - 0.99 ** step)) + np.float32(p.damping))
        if 2 * epoch >= p.epochs:  # the model is the mean over the later epochs
            taken += 1
            bucket += var[0] @ (var[1][:, 1] - var[1][:, 0])
            bias += var[2][1] - var[2][0]
    return Model(bucket / taken, float(bias / taken), p)


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    col = col.combine_chunks()
    at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    return [flat[at[i]:at[i + 1]] for i in range(len(col))]


def probabilities(model: Model, text: pa.Array) -> pa.Array:
    """Probability of label 1 for every text of an Arrow array."""
    bucket, bias, p = model.bucket, model.bias, model.params
    out = [np.empty(0)]
    for _, _, buf, offs in chunks(text, 2 * PIECE):
        w = words(buf, offs)
        z = np.zeros(w.n_docs)
        if len(w.h):
            u, first, of = np.unique(w.h, return_index=True, return_inverse=True)
            x, begin = subwords(buf, w.start[first], w.end[first], u, p)
            n = np.diff(np.append(begin, len(x)))
            logit = np.add.reduceat(bucket[x].astype(np.float64), begin) / n
            count = np.bincount(w.doc, minlength=w.n_docs)
            z = np.bincount(w.doc, weights=logit[of], minlength=w.n_docs) / np.maximum(count, 1)
        with np.errstate(over="ignore"):
            out.append(1 / (1 + np.exp(-(z + bias))))
    return pa.array(np.concatenate(out), pa.float64())


def scorer(model: Model):
    """Arrow UDF of ``probabilities``."""
    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return probabilities(model, text)
    return toxicity


def toxicity_scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
                    held_out_mod: int = 5, threshold: float = 0.5) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    prepare(docs.sparkSession)
    s = docs.select(F.col(id_col), F.coalesce(crc_mod(id_col, held_out_mod) == 0, F.lit(False)).alias("held_out"),
                    scorer(model)(F.col(text_col).cast("string")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, columns unchanged."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, params=params)
    return docs.where(scorer(model)(F.col(text_col).cast("string")) < threshold)
