from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from edge_tables import edge, no_docs, table  # noqa: F401
from spendlens.llm import periodic as P
from spendlens.llm import queries as Q


def brute(w, min_words=24, min_periods=3):
    """Runs by comparing the words of every period."""
    out = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(min_words, min_periods * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretch(rng, k):
    w = [rng.randrange(k) for _ in range(rng.randrange(0, 30))]
    for _ in range(rng.randrange(4)):
        block = [rng.randrange(k) for _ in range(rng.randrange(1, 12))]
        w += (block * 12)[:rng.randrange(1, 90)] + [rng.randrange(k) for _ in range(rng.randrange(0, 9))]
    return w


@pytest.mark.parametrize("seed, least", [(1, (24, 3)), (2, (4, 2)), (3, (6, 3)), (4, (10, 4))])
def test_runs_of(seed, least):
    rng = random.Random(seed)
    for k in [1, 2, 2, 3, 5, 40] * 60:
        w = stretch(rng, k)
        assert P.runs_of(w, *least) == brute(w, *least)


@pytest.mark.parametrize("least", [(24, 3), (9, 3), (12, 2)])
def test_stretches_hold_every_run(least):
    rng = random.Random(7)
    k = P._width(*least)
    for _ in range(60):
        texts = [stretch(rng, rng.choice([2, 3, 30])) for _ in range(4)]
        h = np.array([x + 1 for t in texts for x in t], np.uint64)
        doc = np.repeat(np.arange(4), [len(t) for t in texts])
        found = list(zip(*(x.tolist() for x in P._stretches(h, doc, k, least[0])), strict=True))
        at = 0
        for t in texts:
            for s, n, _ in brute(t, *least):
                assert any(a <= at + s and at + s + n <= b for a, b in found)
            at += len(t)


@pytest.mark.parametrize("words", [[0] * 20_000, [i % 6_000 for i in range(20_000)], [i % 7 for i in range(20_000)]])
def test_time_is_near_linear(words):
    t = time.perf_counter()
    assert len(P.runs_of(words)) == 1
    assert time.perf_counter() - t < 5


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    short = [(i, x) for i, x in rows if len((x or "").split()) < 800]
    got = {r.doc_id: tuple(r) for r in Q.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and len(short) > 100
    assert [got[i] for i, _ in short] == [expected(i, x) for i, x in short]
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_collapsed_text_and_runs(spark):
    text = "Intro words\there " + "na  na\nbatman " * 12 + "the end"
    docs = spark.createDataFrame([(1, text), (2, "never again")], "doc_id long, text string")
    a, b = sorted(P.periodic_runs(docs).collect())
    assert a.collapsed == "Intro words here na na batman the end"
    assert [tuple(r) for r in a.runs] == [(3, 36, 3)] and (a.start, a.length, a.period, a.exponent_milli) == (3, 36, 3, 12_000)
    assert b.collapsed == "never again" and b.runs == []


def test_edges(edge, no_docs):
    out = P.periodic_runs(edge, full=False).collect()
    by = {r.doc_id: r for r in out}
    none = hashlib.sha256(b"").hexdigest()
    assert len(out) == 9 and None in by
    for i in (1, 2, 3):
        assert by[i].n_runs == 0 and by[i].start is None and by[i].runs_sha256 == by[i].collapsed_sha256 == none
    assert (by[6].n_runs, by[6].start, by[6].length, by[6].period) == (1, 0, 30_000, 1)
    assert by[6].collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert P.periodic_runs(no_docs).collect() == []
