from __future__ import annotations

import random

import numpy as np
import pytest

from edge_tables import edge, no_docs  # noqa: F401
from spendlens.llm import minmax as M
from spendlens.llm import ngram_join as N
from test_ngram_join import brute, corpus, got


@pytest.mark.parametrize("seed, params", [(1, {}), (2, {"heavy": 2}), (3, {"heavy": 0, "seed": 5})])
def test_against_all_pairs(spark, seed, params):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = M.minmax_duplicates(docs, **params)
    assert got(out) == brute(rows, width=4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_crowded_buckets(spark, monkeypatch):
    """Unlike copies of one text, all in crowded buckets, cut into several blocks."""
    monkeypatch.setattr(N, "MEMBERS", 16)
    rng = random.Random(5)
    base = rng.choices(range(500), k=60)
    rows = []
    for i in range(120):
        v = list(base)
        for _ in range(i % 5):
            v[rng.randrange(60)] = rng.randrange(500)
        rows.append((i, " ".join(map(str, v[rng.randrange(3):]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, width=4)
    assert 1 < len({c for *_, c in want}) < 100
    assert got(M.minmax_duplicates(docs, heavy=4)) == want


def test_agreement_is_unbiased_and_tighter_than_minima():
    rng = np.random.default_rng(3)
    a, b = M.permutations(64, 1)
    wide = M.permutations(128, 2)
    mm, only = [], []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        s, u = x[:200], x[100:]  # similarity 1/3
        mm.append((M.signature(s, a, b) == M.signature(u, a, b)).mean())
        only.append((M.signature(s, *wide)[0] == M.signature(u, *wide)[0]).mean())
    assert abs(np.mean(mm) - 1 / 3) < 0.012
    assert np.var(mm) < 1.1 * np.var(only)


def test_signatures_of_many_sets():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 5, 80)]
    a, b = M.permutations(8, 1)
    got_ = M._signatures(np.concatenate(sets), np.array([0, 1, 6]), a, b)
    for k, s in enumerate(sets):
        assert (got_[k] == M.signature(s, a, b)).all()
    assert M._buckets(got_, 4).shape == (3, 4)


def test_edges(edge, no_docs):
    out = [tuple(r) for r in M.minmax_duplicates(edge).collect()]
    by = {}
    for i, n, c, kept in out:
        by.setdefault(i, []).append((n, c, kept))
    assert len(out) == 9
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] and by[6] == [(1, 6, True)]
    assert by[7] == [(3, 7, True)] * 2 and by[None] == [(8, None, True)]
    assert M.minmax_duplicates(no_docs).collect() == []
