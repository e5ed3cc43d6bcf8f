from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from edge_tables import edge, no_docs, table  # noqa: F401
from spendlens.llm import cotraining as C
from spendlens.llm import lm as L
from spendlens.llm import toxicity as T

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return [x for x in (text or "").translate(LOWER).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]


def auc(score, y):
    rank = score.argsort().argsort() + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(y) - n1)


@pytest.fixture(scope="module")
def judged(table):
    """Held-out rows of the larger table with both models' scores."""
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    tox = T.train(docs, labels)
    good = C.train(docs, labels)
    frame = (labels.join(T.toxicity_scores(docs, tox).select("doc_id", "held_out", "score", "predicted"), "doc_id")
             .join(C.quality_scores(docs, good).selectExpr("doc_id", "score as q", "text_score", "meta_score", "kept"), "doc_id")).toPandas()
    return tox, frame[frame.held_out]


def test_toxicity_on_held_out_rows(judged):
    tox, x = judged
    y = x.toxic.to_numpy()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in x.doc_id)
    assert auc(x.score.to_numpy(), y) > 0.9 and (x.predicted == y).mean() > 0.93
    p = T.probabilities(tox, pa.array(["the of and " * 5, "the of and " * 5 + "idiot", "the of and " * 5 + "idiotts", None, ""])).to_numpy()
    assert p[1] > 0.9 and p[2] > p[0] and p[3] == p[4]


def test_quality_on_held_out_rows(judged):
    _, x = judged
    y = x.quality.to_numpy()
    assert auc(x.q.to_numpy(), y) > 0.9 and x.kept[x.quality == 1].mean() > 0.98 and x.kept[x.quality == 0].mean() < 0.5
    assert auc(x.q.to_numpy(), y) >= max(auc(x.text_score.to_numpy(), y), auc(x.meta_score.to_numpy(), y)) - 0.01


def test_classifier_edges(spark, edge, no_docs, table):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for y in (labels, none):
        t = T.train(edge, y, held_out_mod=None)
        c = C.train(edge, y, held_out_mod=None)
        a = T.toxicity_scores(edge, t).collect()
        b = C.quality_scores(edge, c).collect()
        assert len(a) == len(b) == 9 and all(0 <= r.score <= 1 for r in [*a, *b])
        assert T.toxicity_scores(no_docs, t).collect() == [] == C.quality_scores(no_docs, c).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in a) and all(r.kept for r in b)
    assert T.drop_toxic(edge, none).count() == 9
    only = labels.where("toxic = 0")
    assert T.drop_toxic(edge, only).columns == edge.columns


def test_co_training_exchanges_labels(judged, table):
    assert C.train(table("documents", "sf0.1"), table("labels", "sf0.1")).n_pseudo > 0


SMALL = L.Params(dim=4, classes=6, buckets=9, context=7, stride=4, steps=30, sample=50)


def test_gradient():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in L.initial(SMALL).items()}
    x, y = rng.integers(0, 9, (3, 7)), rng.integers(0, 6, (3, 4))
    keys = np.where(rng.random((3, 7)) < 0.2, -1e9, 0)
    keys[:, -4:] = 0
    scored = rng.random((3, 4)) < 0.8
    causal = L.Windows(np.array([0]), np.array([9]), SMALL).causal.astype(float)

    def loss():
        z, _ = L.forward(m, x, keys, causal, SMALL)
        return -(np.take_along_axis(z, y[..., None], -1)[..., 0] * scored).sum() / scored.sum()
    z, kept = L.forward(m, x, keys, causal, SMALL)
    d = L.gradient(m, x, z, kept, y, scored, SMALL)
    for k in m:
        at = tuple(rng.integers(0, n) for n in m[k].shape)
        m[k][at] += 1e-5
        up = loss()
        m[k][at] -= 2e-5
        down = loss()
        m[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - d[k][at]) < 1e-5


def test_windows_score_each_token_once_and_never_look_ahead():
    length = np.array([1, 4, 5, 23])
    start = np.cumsum(length) - length
    ids = np.arange(length.sum())
    w = L.Windows(start, length, SMALL)
    x, keys, scored, y = w.take(slice(None), ids, -1)
    assert sorted(y[scored]) == ids.tolist()
    for k in range(len(x)):
        for j in range(SMALL.stride):
            if scored[k, j]:
                seen = x[k][(keys[k] == 0) & (w.causal[j] == 0)]
                assert seen.max() < y[k, j] and (seen >= start[w.text[k]] - 1).all() or (seen == -1).any()
                assert y[k, j] == start[w.text[k]] or y[k, j] - 1 in seen


def test_lm_against_counts(table):
    docs = table("documents")
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for r in train for w in split(r.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    out = {r.doc_id: r for r in L.lm_scores(docs, params=L.Params(steps=50, sample=60, hot_words=500)).collect()}
    for r in rows:
        o, w = out[r.doc_id], split(r.text)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (o.n_tokens, o.n_known, o.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert o.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(o.base_score - base) < 1e-6 * max(1, abs(base)) and o.score < 0


def test_lm_is_a_distribution_and_learns(table):
    text = [r.text for r in table("documents").where("lang = 'en'").limit(60).collect()]
    enc, end = L._encoding(L.VOCABULARY)
    t = L.Tokens(*texts_of(text), L.VOCABULARY)
    starts = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(end)])
    own = [t.ids[s:s + n] for s, n in zip(t.start, t.length, strict=True)]
    p = L.Params(steps=200)
    lay, m = L.warm_start(own[:40], starts, p)
    sub = np.bincount(np.concatenate(own[:40]), minlength=end + 1).astype(float)
    mass = np.bincount(lay.cls, weights=sub + p.smoothing, minlength=p.classes)
    within = np.log((sub + p.smoothing) / mass[lay.cls])
    assert np.allclose(np.bincount(lay.cls, weights=np.exp(within))[np.unique(lay.cls)], 1)
    model = L.Model(L.VOCABULARY, p, lay, m, within, None, None, 0, 0, 0)
    plain = np.log10((sub + p.smoothing) / (sub + p.smoothing).sum())
    uni = sum(plain[x].sum() for x in own[40:])
    assert L.log10_probability(t, model)[40:].sum() > uni


def texts_of(text):
    raw = [x.encode() for x in text]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_lm_edges(edge, no_docs):
    out = L.lm_scores(edge, params=SMALL).collect()
    assert len(out) == 9 and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in out)
    assert {r.doc_id: r.n_tokens for r in out}[6] == 30_001
    assert L.lm_scores(no_docs, params=SMALL).collect() == []


def test_lm_trains_on_every_window(table):
    docs = table("documents").selectExpr("doc_id as id", "text")
    p = L.Params(steps=5, sample=20)
    model, _ = L.train(docs, params=p)
    t = L.Tokens(*texts_of([r.text or "" for r in docs.collect()]), L.VOCABULARY)
    assert model.n_windows == int((-(-t.length // p.stride)).sum())


def test_wide_logits_are_stable():
    m = {k: 30 * v for k, v in L.initial(SMALL).items()}
    w = L.Windows(np.array([0]), np.array([23]), SMALL)
    x, keys, scored, y = w.take(slice(None), np.arange(23) % 9, 0)
    z, kept = L.forward(m, x, keys, w.causal, SMALL)
    d = L.gradient(m, x, z, kept, y % 6, scored, SMALL)
    assert np.allclose(np.exp(z[scored]).sum(-1), 1, atol=1e-4)
    assert all(np.isfinite(v).all() for v in d.values())


def test_lm_layout_counts_all_training_texts(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "omega sigma kappa") for i in range(40)], "id long, text string")
    p = L.Params(steps=2, sample=1)
    model, _ = L.train(docs, params=p)
    enc, end = L._encoding(L.VOCABULARY)
    starts = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(end)])
    t = L.Tokens(*texts_of([r.text for r in docs.collect()]), L.VOCABULARY)
    want = L.layout(np.bincount(t.ids, minlength=end + 1).astype(float), starts, p)
    assert (model.layout.cls == want.cls).all() and (model.layout.bucket == want.bucket).all()


def test_samples_are_bounded_whatever_repeats(spark):
    """One id in most rows, and many rows without one, neither grow what is trained on."""
    docs = spark.createDataFrame([(1, f"words of row {i}") for i in range(3000)] + [(None, f"no id {i}") for i in range(500)]
                                 + [(i, f"text {i} of many") for i in range(2, 80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 80)], "doc_id long, quality int, toxic int")
    rows = T.training_rows(docs, labels, "doc_id", "text", "toxic", None, 60).collect()
    assert len(rows) == 60
    own = labels.selectExpr("doc_id as id", "double(quality) as y").limit(40)
    src = C._source(docs, "doc_id", "text", [])
    assert C._features(src, own, C.Params(), [], "y double").num_rows == 40
    model, _ = L.train(docs.selectExpr("doc_id as id", "text"), params=SMALL)
    assert model.n_texts == 3578


def test_every_unlabelled_row_can_get_a_pseudo_label(spark):
    """The rows that a view is surest of are found wherever they are."""
    docs = [(i, ("good fine nice " if i % 2 else "bad worse junk ") * 8, "a", "en") for i in range(400)]
    docs += [(i, "middling text " * 8, "b", "en") for i in range(400, 3000)]
    docs += [(i, "good fine nice " * 40, "c", "en") for i in range(3000, 3010)]
    labels = [(i, i % 2) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(7)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    p = C.Params(rounds=1)
    src = C._source(frame, "doc_id", "text", ["source", "lang"])
    state = C.CoTraining(C._features(src, y.selectExpr("doc_id as id", "double(quality) as y"), p, ["source", "lang"], "y double"), p, ["source", "lang"])
    sure = src.mapInArrow(C._surest(state.fit(), state.most), f"id long, {C._SURE}").where("view = 1 and y = 1").collect()
    best = sorted(sure, key=lambda r: -r.sure)[:10]
    assert best and all(r.id % 2 if r.id < 400 else r.id >= 3000 for r in best)
    m = C.train(frame, y, held_out_mod=None, params=p)
    assert 0 < m.n_pseudo <= 4 * state.most
    q = {r.doc_id: r.score for r in C.quality_scores(frame, m).collect()}
    assert len(q) == len(docs) and q[3001] > 0.9 > 0.1 > q[2]


def test_words_encoded_at_once_are_encoded_alone():
    enc, _ = L._encoding(L.VOCABULARY)
    own = ["the", "don't", "a1b2", "x\u00a0", "\u00a0y", "\u3000", "漢字かな", "é́", "#$%", "it's'd", "\u2028z", "𝒳", "'s", "...", "a\u00a0\u00a0b", "\x1f", "\x85q"]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        pick = [own[i] for i in rng.integers(0, len(own), 40)]
        size, flat = L.encoded([x.encode() for x in pick], L.VOCABULARY)
        want = [enc.encode_ordinary(" " + x) for x in pick]
        assert size.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert L.encoded([], L.VOCABULARY)[1].tolist() == []
