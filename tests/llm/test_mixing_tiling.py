from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from edge_tables import edge, no_docs, table  # noqa: F401
from spendlens.llm import tiling as G
from spendlens.llm.mixing import mix_sources, source_rates


def test_poisson_by_hand(table):
    """Counts of every document against an inversion in Python."""
    docs = table("documents", "sf0.01")
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    got: dict = {}
    for r in mix_sources(docs).select("doc_id", "copy", "n_copies").collect():
        got.setdefault(r.doc_id, []).append((r.copy, r.n_copies))
    for r in docs.select("doc_id", "source").collect():
        rate = rates[r.source]
        parts = max(1, math.ceil(rate / 32))
        n = 0
        for j in range(parts):
            u = int(hashlib.md5(f"17|{j}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        assert sorted(got.get(r.doc_id, [])) == [(k, n) for k in range(n)]


def test_targets(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 10 else "small", 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.source: r["count"] for r in mix_sources(docs, weights={"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert abs(out["big"] - 2000) < 200 and abs(out["small"] - 2000) < 250
    out = mix_sources(docs, weights={"small": 1.0}, unit="rows", size=2.0)  # a rate of 20
    assert abs(out.count() - 8000) < 400 and out.select("source").distinct().count() == 1
    big = mix_sources(docs.limit(2), weights={"big": 1.0}, unit="rows", size=600.0)  # a rate above SPLIT
    assert 900 < big.count() < 1500


def test_mixing_edges(edge, no_docs):
    out = mix_sources(edge, unit="rows", size=5.0)
    added = ["copy", "n_copies", "shuffle_key"]
    assert out.columns == [*[c for c in edge.columns if c not in added], *added]
    twice = [r.n_copies for r in out.where("doc_id = 7 and copy = 0").collect()]
    assert len(set(twice)) <= 1
    assert out.count() > 9 and mix_sources(no_docs).collect() == []
    keys = [r.shuffle_key for r in out.coalesce(1).collect()]
    assert len(keys) == out.count()


def slow_tiles(item, text, shortest):
    """Greedy string tiling by trying all starts; the covered item words."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (i + k < len(item) and j + k < len(text) and free_i[i + k] and free_t[j + k] and item[i + k] == text[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < min(shortest, len(item)) or k == 0:
            return len(item) - sum(free_i)
        for x in range(k):
            free_i[i + x] = free_t[j + x] = False


def test_tiles_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))]
        cut = rng.randrange(len(item))
        text[3:3] = item[cut:] + [9] + item[:cut]
        tiles = G.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        for i, j, k in tiles:
            assert item[i:i + k] == text[j:j + k]
        used = [x for i, _, k in tiles for x in range(i, i + k)]
        assert len(used) == len(set(used)) == slow_tiles(item, text, 3)


def test_contaminated(spark, table, edge, no_docs):
    bench = table("benchmark")
    items = [r.text.split() for r in bench.orderBy("item_id").collect()]
    half = len(items[3]) // 2
    rows = [(1, "before " + " ".join(items[0]) + " after"), (2, " ".join(items[3][half:] + ["and"] + items[3][:half])),
            (3, " ".join(items[5][:len(items[5]) // 3])), (4, "nothing of it here at all"), (5, " ".join(items[0]).upper()),
            (None, " ".join(items[7])), (None, "clean without an id"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.item_ids for r in G.contaminated(docs, bench).collect()}
    assert out == {1: [0], 2: [3], 5: [0], None: [7]}
    left = G.drop_contaminated(docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, 3), (False, 4), (False, 6), (True, 0)]
    assert G.contaminated(edge, bench).collect() == [] and G.contaminated(no_docs, bench).collect() == []
    assert G.drop_contaminated(edge, bench).count() == 9
    tiny = spark.createDataFrame([(0, "one two"), (1, None), (2, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in G.contaminated(edge, tiny).collect()) == [4, 5]
    assert G.contaminated(docs, tiny.limit(0)).collect() == []


def test_planted_passages_of_the_tables(table):
    docs, bench = table("documents", "sf0.01"), table("benchmark", "sf0.01")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, x in items.items() if x in " ".join(r.text.lower().split())}
    got = {(r.doc_id, i) for r in G.contaminated(docs, bench).collect() for i in r.item_ids}
    assert want <= got
