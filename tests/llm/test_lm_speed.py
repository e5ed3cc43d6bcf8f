"""Operator 10: words told apart by hash, scores that no block of windows changes."""

from __future__ import annotations

import dataclasses
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from spendlens.llm import lm as L


def test_distinct_words_come_in_order_of_their_first_places():
    h = np.random.default_rng(2).integers(0, 40, 500).astype(np.uint64) << np.uint64(58)
    word, first, of = L.distinct(h)
    assert (word[of] == h).all() and (h[first] == word).all() and (np.diff(first) > 0).all()
    sorted_word, at = np.unique(h, return_index=True)
    assert sorted(word.tolist()) == sorted_word.tolist() and sorted(first.tolist()) == sorted(at.tolist())
    assert [len(x) for x in L.distinct(np.empty(0, np.uint64))] == [0, 0, 0]


def test_texts_are_scored_alike_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["red", "green", "blue-ish", "x1"], n)) for n in (0, 1, 15, 16, 40, 700)]
    t = next(L.token_stream(pa.array(texts), L.VOCABULARY))[1]
    p = dataclasses.replace(L.Params(), steps=3)
    lay, m = L.warm_start([t.ids], L._starts_word(L.VOCABULARY), p)
    within = np.log(np.random.default_rng(4).random(len(lay.cls)))
    model = L.Model(L.VOCABULARY, p, lay, m, within, np.empty(0, np.uint64), np.empty(0, np.int64), 1, 1, 1)
    got = []
    for k in (1, 7, 512):
        monkeypatch.setattr(L, "SCORED_TOGETHER", k)
        got.append(L.log10_probability(t, model))
    assert np.allclose(got[0], got[2], rtol=1e-6) and np.allclose(got[1], got[2], rtol=1e-6)
    # Each text alone, position by position in windows of its own.
    alone = [L.log10_probability(next(L.token_stream(pa.array([x]), L.VOCABULARY))[1], model)[0] for x in texts]
    assert np.allclose(alone, got[2], rtol=1e-6)


def test_adam_steps_all_parameters_as_each_alone():
    p = L.Params()
    m, rng = L.initial(p), np.random.default_rng(5)
    opt = L.Adam({k: v.copy() for k, v in m.items()}, p.rate)
    a, b = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for t in range(1, 4):
        d = {k: rng.normal(0, 1, v.shape).astype(np.float32) for k, v in m.items()}
        opt.step(dict(reversed(d.items())))
        fix = p.rate * (1 - 0.99 ** t) ** 0.5 / (1 - 0.9 ** t)
        for k, g in d.items():
            a[k] += 0.1 * (g - a[k])
            b[k] += 0.01 * (g * g - b[k])
            m[k] -= (fix * a[k] / (np.sqrt(b[k]) + 1e-8)).astype(np.float32)
    assert all((opt.m[k] == m[k]).all() for k in m)


def test_texts_are_cut_once_for_counts_training_and_scores(spark):
    """Before, every training text was cut into subwords again to be scored."""
    rows = [(0, "Red red blue", False), (1, "blue x9 x9", True), (2, None, False), (None, "", True)]
    rows = spark.createDataFrame(rows, "rid long, text string, held_out boolean").coalesce(1)
    got = L.gathered(rows).collect()
    t = L.Tokens(*(lambda raw: (np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))(
        [(r.text or "").encode() for r in rows.collect()]), L.VOCABULARY)
    texts = {r.rid: r for r in got if r.kind >= 3}
    assert {k: r.kind for k, r in texts.items()} == {0: 3, 1: 4, 2: 3, None: 4}
    assert [texts[k].n for k in (0, 1, 2, None)] == t.length.tolist()
    assert b"".join(texts[k].data for k in (0, 1, 2, None)) == t.ids.astype(L._stored_id(L._encoding(L.VOCABULARY)[1])).tobytes()
    words = {k: np.frombuffer(r.words, L._WORD).tolist() for k, r in texts.items()}
    assert [sorted(n for _, n in words[k]) for k in (0, 1, 2, None)] == [[1, 2], [1, 2], [], []]
    # Counts are those of the training texts alone.
    assert {r.key: r.n for r in got if r.kind == 0} == dict(words[0])
    mine = np.bincount(np.concatenate([t.ids[:t.length[0]], t.ids[-2:-1]]))
    assert {r.key: r.n for r in got if r.kind == 1} == {i: mine[i] for i in np.flatnonzero(mine)}
    assert [r.n for r in got if r.kind == 2] == [2]


def test_masked_first_keys_change_nothing():
    """What lies before a text's first position has no weight, whatever is read there."""
    p = L.Params()
    w = L.Windows(np.array([0, 20]), np.array([20, 5]), p)
    x, keys, scored, _ = w.take(slice(None), np.arange(25), 3)
    assert scored.sum(1).tolist() == [16, 4, 5] and (keys[0, :8] < 0).all() and (keys[1, :8] == 0).all() and (keys[2, :8] < 0).all()
    z, _ = L.forward(L.initial(p), x, keys, w.causal, p)
    other, _ = L.forward(L.initial(p), np.where(keys < 0, 77, x), keys, w.causal, p)
    assert np.allclose(z[scored], other[scored], atol=1e-6)


def test_windows_hold_few_bytes_a_token():
    """Before, places of tokens were two arrays of long integers, made from more of them."""
    length = np.random.default_rng(6).integers(1, 900, 700)
    start, ids = np.cumsum(length) - length, np.zeros(length.sum(), np.uint16)
    tracemalloc.start()
    try:
        take = L.Windows(start, length, L.Params()).over(ids, 3, ids.astype(np.uint8))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert take(slice(0, 1))[2].all() == (length[0] >= 16) and most < 16 * len(ids)


def test_stored_ids_lie_in_small_row_groups(spark, monkeypatch):
    """Before, a task held all its rows as one row group, to write and to read them."""
    monkeypatch.setattr(L, "ROW_GROUP", 1 << 16)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), (200, 6)).view("U6").ravel()), i % 7 == 2) for i in range(600)]
    rows = spark.createDataFrame(rows, "rid long, text string, held_out boolean").coalesce(1)
    got = L.gathered(rows)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in got.inputFiles()]
    sizes = [f.metadata.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)]
    assert len(files) == 1 and len(sizes) > 5 and max(sizes) < 8 << 16
    assert got.where("kind >= 3").count() == 600


def test_counts_leave_a_task_in_short_batches(monkeypatch):
    """Before, all counted words of a task were one batch."""
    monkeypatch.setattr(L, "COUNTS_TOGETHER", 100)
    texts = [" ".join(f"w{i}" for i in range(k, k + 350)) for k in (0, 200)]
    b = pa.RecordBatch.from_pydict({"rid": [1, 2], "held_out": [False, False], "text": texts})
    out = [x for x in L._gather(L.VOCABULARY, L._encoding(L.VOCABULARY)[1])([b]) if x.column("kind")[0].as_py() == 0]
    assert max(map(len, out)) == 100 and sum(map(len, out)) == 550
    assert sorted(n for x in out for n in x.column("n").to_pylist()) == [1] * 400 + [2] * 150


def test_texts_are_cut_in_short_runs():
    """Before, arrays over the words of 4 MB of text lived at the same time."""
    word = [f"w{i}" for i in range(2_000)]
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(word, 5_000)) for _ in range(160)]
    b = pa.RecordBatch.from_pydict({"rid": range(160), "held_out": [False] * 160, "text": texts})
    L._starts_word(L.VOCABULARY)
    tracemalloc.start()
    try:
        got = sum(len(x) for x in L._gather(L.VOCABULARY, L._encoding(L.VOCABULARY)[1])([b]) if x.column("kind")[0].as_py() == 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 160 and b.nbytes > 4 << 20 and most < 48 << 20
