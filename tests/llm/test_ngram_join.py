from __future__ import annotations

import random

import pytest

from edge_tables import edge, no_docs  # noqa: F401
from spendlens.llm import ngram_join as N

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, width=5, t=80):
    """(id, size, component) of every row by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = [x for x in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append((i, {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= t * len(s | u):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i)) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed, n_groups=6, variants=25):
    """Groups of variants (a hot one among them), a passage that many share, and chains."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=30)
    texts = [passage + rng.choices(vocabulary, k=rng.randrange(5, 60)) for _ in range(60)]
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=rng.randrange(20, 90))
        for _ in range(variants if g else 4 * variants):
            v = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(v[rng.randrange(2):])
        chain = list(base)
        for _ in range(8):
            chain = chain[2:] + rng.choices(vocabulary, k=2)
            texts.append(list(chain))
    texts += [rng.choices(vocabulary, k=k) for k in (1, 2, 4, 5, 6)] + [["Solo"], ["SOLO"]]
    rng.shuffle(texts)
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


@pytest.mark.parametrize("seed, params", [(1, {}), (2, {"common_df": 2}), (3, {"common_df": 10_000, "salts": 3})])
def test_against_all_pairs(spark, monkeypatch, seed, params):
    monkeypatch.setattr(N, "MEMBERS", 16)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.ngram_join(docs, **params)) == brute(rows)


def test_edges(edge, no_docs):
    out = [tuple(r) for r in N.ngram_join(edge).collect()]
    assert len(out) == 9
    by = {}
    for i, n, c in out:
        by.setdefault(i, []).append((n, c))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[4] == [(1, 4)] and by[5] == [(1, 4)] and by[6] == [(1, 6)]
    assert by[7] == [(2, 7)] * 2
    assert by[None][0][0] > 0 and by[None][0][1] is None
    assert N.ngram_join(no_docs).collect() == []


def test_one_per_component(edge, spark):
    out = N.one_per_component(edge)
    assert out.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(
        (x is None, x or 0) for x in (1, 2, 3, 4, 6, 7, None))


def test_one_per_component_of_repeated_rows(spark):
    a, b, c = "one two three four five six seven", "other words of another text that is long", "some lines without any id at all here"
    rows = [(7, a)] * 5 + [(8, a), (7, a.upper()), (7, b), (9, b), (None, b), (None, c), (None, c), (None, c.title()),
                           (None, None), (None, None), (5, ""), (5, ""), (6, "")]
    out = N.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(set(out)) == 6
    assert {(r.doc_id, (r.text or "").lower()) for r in out} == {(7, a), (7, b), (None, c), (None, ""), (5, ""), (6, "")}


def test_packing_round_trip():
    import numpy as np
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        x = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64))
        assert (N._unpack(N._pack(x)) == x).all()


def test_one_row_stands_for_a_class(spark):
    """Copies under many ids, under one id and without an id, over several
    tasks: every class keeps a row, and one of many ids alone."""
    rows = [(i, "copy of a text that comes under many ids") for i in range(40, 80)]
    rows += [(None, "text without any id that comes a few times")] * 9 + [(3, "one id with equal rows")] * 9
    rows += [(100 + i, f"text {i} that comes once") for i in range(50)]
    of = {t: next(N._class(s) for _, s in N._sets(N.pa.array([t]), 5)) for _, t in rows}
    docs = spark.createDataFrame([(i, t, of[t]) for i, t in rows], "id long, text string, cls long")
    classes = docs.groupBy("cls").agg(N.F.min("id").alias("low"), N.F.count("*").alias("copies"))
    keyed = docs.select("id", "text", "cls", N.F.xxhash64("id").alias("key")).collect()
    all_hit = N._firsts(classes.withColumn("copies", N.F.lit(2)))  # as if the bitmap held every class
    for firsts in (N._firsts(classes), all_hit):
        stay = [(r.id, r.text) for r in keyed if firsts.stands(r.cls, r.key)]
        assert {t for _, t in stay} == {t for _, t in rows}
        assert [i for i, t in stay if t.startswith("copy")] == [40]
