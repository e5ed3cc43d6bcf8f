from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import cover_tree as C

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, block int"


def rows_of(seed, n=300, dim=6):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    out = []
    for i in range(n):
        h = rng.choice(heads)
        out.append((i, [x + rng.gauss(0, 0.3) for x in h], rng.randrange(3), "x", "y", 1))
    for i in range(n, n + 40):  # ties: equal vectors under several labels
        out.append((i, out[0][1], i % 3, "x", "y", 1))
    return out


def brute(rows, every=10, k=5, least=80):
    good = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        good[i] = min(good.get(i, w), w)
    score = lambda a, b: sum(x * y for x, y in zip(good[a][1], good[b][1], strict=False))
    out = []
    for a in good:
        if a % every:
            continue
        near = sorted((-score(a, b), b) for b in good if b != a and good[b][0] == good[a][0])[:k]
        far = sorted((-score(a, b), b) for b in good if good[b][0] != good[a][0])
        for p, i in near:
            hit = [(s, j) for s, j in far if least * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(hit, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, block, leaf, per_round", [(1, 8192, 32, 16_384), (2, 40, 4, 16_384), (3, 64, 2, 16)])
def test_against_brute_force(spark, monkeypatch, seed, block, leaf, per_round):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "ROUND", per_round)
    rows = rows_of(seed)
    got = C.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(4, 60) + [(None, [1.0] * 6, 1, "", "", 0), (1000, None, 1, "", "", 0), (1010, [1.0] * 6, None, "", "", 0),
                             (1020, [1.0, nan, 0.0, 0.0, 0.0, 0.0], 1, "", "", 0), (1030, [inf] * 6, 1, "", "", 0),
                             (1040, [1.0, None], 1, "", "", 0), (1050, [], 1, "", "", 0), (1060, [0.5, 1.0], 2, "", "", 0),
                             (1070, [0.0] * 6, 0, "", "", 0)]
    rows += [rows[0], (0, rows[1][1], 2, "", "", 0)]  # repeated id, once with another vector
    got = C.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    none = C.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0)
    assert none.collect() == [] and none.columns == got.columns


def test_nodes_cover_what_is_below_and_bounds_hold():
    rng = np.random.default_rng(2)
    heads = rng.normal(0, 200, (5, 8))
    x = np.floor(heads[rng.integers(0, 5, 900)] + rng.normal(0, 12, (900, 8)))
    t = C.CoverTree(np.arange(900), np.zeros(900, np.int64), x)
    assert sum(not leaf for leaf in t.leaf) > 3
    q = np.floor(rng.normal(0, 150, (20, 8)))
    low, high = t.bounds(q)
    seen = []

    def below(node):
        if t.leaf[node]:
            seen.extend(t.below[node].tolist())
            return t.below[node]
        return np.concatenate([below(c) for c in t.below[node]])

    for node in range(len(t.centre)):
        seen.clear()
        s = q @ x[below(node)].T
        assert (s.min(1) >= low[:, node]).all() and (s.max(1) <= high[:, node]).all()
        if node == 0:
            assert sorted(seen) == list(range(900))


def test_descent_skips_nodes():
    rng = np.random.default_rng(6)
    heads = rng.normal(0, 300, (30, 8))
    x = np.floor(heads[np.arange(3000) % 30] + rng.normal(0, 5, (3000, 8)))
    t = C.CoverTree(np.arange(3000), np.zeros(3000, np.int64), x)
    seen = [0]

    class Rows(np.ndarray):
        def __getitem__(self, at):
            seen[0] += len(at) if isinstance(at, np.ndarray) else 0
            return super().__getitem__(at)
    q = x[7]
    low, high = t.bounds(q[None, :])
    t.x = x.view(Rows)
    best = []
    t.search(q, low[0], high[0], np.ones(3000, bool), -math.inf, math.inf, best, 5)
    assert sorted((-s, -i) for s, i in best) == sorted(zip((-(x @ q)).tolist(), range(3000), strict=True))[:5]
    assert 0 < seen[0] < 1500
