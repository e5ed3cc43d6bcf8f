"""Benchmark decontamination (operator 7): greedy string tiling.

A document is compared with the benchmark items that share a seed with it, a
run of ``seed`` words.  For such a pair, the longest runs of words that both
have and that no tile covers yet are marked again and again (running
Karp-Rabin: window hashes of one length find the matches, then the length
falls), down to ``seed`` words.  The share of an item's words under tiles is
its coverage; the order of tiles does not matter, so reordered passages count.
A document is contaminated by the items whose coverage reaches ``threshold``.

Seeds of the items form a bitmap of fixed size that the scan of the documents
uses; what passes is joined with the items' seeds by hash.  Only the parts of
a text around seeds travel, and a passage that many documents share costs one
row for each document.

Words are lower-cased (A-Z).  Null and empty texts match nothing; an item of
fewer than ``seed`` words is its own only seed, found where the whole item
occurs; items without words are left out.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Bitmap, bitmap_of, prepare, chunks, stored, windows, without, words

_U = np.uint64


def _items(seed: int):
    """Word hashes and seeds of every item."""
    def run(batches):
        for b in batches:
            hs, seeds = [], []
            for _, _, buf, offs in chunks(b.column(1)):
                w = words(buf, offs)
                at = w.bounds()
                for i in range(w.n_docs):
                    h = w.h[at[i]:at[i + 1]]
                    hs.append(h.view(np.int64))
                    seeds.append(windows(h, min(seed, max(1, len(h)))).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, longs), pa.array(seeds, longs)],
                                             ["item_id", "words", "seeds"])
    return run


def _parts(seed: int, known: Bitmap, short: list[int]):
    """For each text with seeds: the seeds found, and the word hashes of the
    stretches that hold them (one list, stretches parted by a zero)."""
    def run(batches):
        for b in batches:
            rows, seeds, parts = [], [], []
            for first, _, buf, offs in chunks(b.column(1)):
                w = words(buf, offs)
                at = w.bounds()
                found = np.zeros(len(w.h), bool)
                keys, owner = [], []
                for k in [seed, *short]:
                    g = windows(w.h, k)
                    hit = np.flatnonzero(known.has(g)) if len(g) else np.empty(0, np.int64)
                    hit = hit[w.doc[hit] == w.doc[hit + k - 1]] if len(hit) else hit
                    for j in range(k):
                        found[hit + j] = True
                    keys.append(g[hit])
                    owner.append(w.doc[hit])
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                for i in np.unique(owner):
                    on = np.flatnonzero(found[at[i]:at[i + 1]]) + at[i]
                    cut = np.flatnonzero(np.diff(on) > 1) + 1
                    rows.append(first + i)
                    seeds.append(np.unique(keys[owner == i]).view(np.int64))
                    parts.append(np.insert(w.h[on], cut, _U(0)).view(np.int64))
            if rows:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(seeds, longs), pa.array(parts, longs)],
                    ["row", "seeds", "parts"])
    return run


def tile(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item position, text position, length)`` of
    non-overlapping tiles, the longest first; ties go to the earliest item
    position, then the earliest text position.  A zero in ``text`` is no word."""
    shortest = min(shortest, len(item))
    if not shortest:
        return []
    free_i, free_t = np.ones(len(item), bool), text != 0
    tiles: list[tuple[int, int, int]] = []

    def starts(h, free, k):
        """Window hashes of length k over free words, and their positions."""
        g = windows(h, k)
        held = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(held[k:] == held[:-k]) if len(g) else np.empty(0, np.int64)
        return g[at], at

    low, high = shortest, min(len(item), len(text))
    while high >= shortest:
        # The longest match: matches of length k imply matches of length k - 1.
        low, best = shortest, 0
        while low <= high:
            k = (low + high + 1) // 2
            if np.isin(starts(item, free_i, k)[0], starts(text, free_t, k)[0]).any():
                best, low = k, k + 1
            else:
                high = k - 1
        if not best:
            break
        gi, pi = starts(item, free_i, best)
        gt, pt = starts(text, free_t, best)
        order = np.argsort(gt, kind="stable")
        gt, pt = gt[order], pt[order]
        for h, i in zip(gi, pi, strict=True):
            if not free_i[i:i + best].all():
                continue
            for j in pt[np.searchsorted(gt, h):np.searchsorted(gt, h, side="right")]:
                if free_t[j:j + best].all() and (item[i:i + best] == text[j:j + best]).all():
                    free_i[i:i + best] = False
                    free_t[j:j + best] = False
                    tiles.append((int(i), int(j), best))
                    break
        high = best
        if not np.isin(starts(item, free_i, best)[0], starts(text, free_t, best)[0]).any():
            high = best - 1
    return tiles


def _cover(seed: int):
    def run(batches):
        for b in batches:
            n, covered, count = [], [], []
            item, text = b.column("words"), b.column("parts")
            for i in range(b.num_rows):
                x = item[i].values.to_numpy().view(_U)
                tiles = tile(x, text[i].values.to_numpy().view(_U), seed)
                n.append(len(x))
                covered.append(sum(k for _, _, k in tiles))
                count.append(len(tiles))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("id"), b.column("digest"), b.column("item_id"), pa.array(n, pa.int64()),
                 pa.array(covered, pa.int64()), pa.array(count, pa.int64())],
                ["rid", "id", "digest", "item_id", "item_words", "covered_words", "n_tiles"])
    return run


def coverage(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", seed: int = 5, threshold: float = 0.6) -> DataFrame:
    """One row for each pair that shares a seed and reaches the threshold:
    row number ``rid``, ``id``, xxhash64 of the text, ``item_id``, words of the item, words covered,
    number of tiles."""
    prepare(docs.sparkSession)
    items = stored(benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                                    F.col(item_text).cast("string").alias("text"))
                   .mapInArrow(_items(seed), "item_id long, words array<long>, seeds array<long>")
                   .where(F.size("words") > 0))
    short = sorted(r.n for r in items.where(F.size("words") < seed)
                   .select(F.size("words").alias("n")).distinct().collect())
    known = bitmap_of(items.select(F.explode("seeds").alias("seed")), "seed", 23)
    src = docs.select(F.struct(F.monotonically_increasing_id().alias("rid"),
                               F.col(id_col).cast("long").alias("id"),
                               F.xxhash64(F.col(text_col).cast("string")).alias("digest")).alias("row"),
                      F.col(text_col).cast("string").alias("text"))
    found = stored(src.mapInArrow(_parts(seed, known, short),
                                  "row struct<rid:long,id:long,digest:long>, seeds array<long>, parts array<long>")
                   .select("row.*", "seeds", "parts"))
    by_seed = (items.select("item_id", F.size("words").alias("n"), F.explode("seeds").alias("seed"))
               .groupBy("item_id", "n", "seed").agg(F.count("*").alias("m")))
    # A pair can only reach the threshold with enough words in common seeds.
    pairs = (found.select("rid", F.explode("seeds").alias("seed")).join(by_seed, "seed")
             .groupBy("rid", "item_id", "n").agg(F.sum("m").alias("c"))
             .where(F.col("c") * seed >= F.col("n") * threshold).select("rid", "item_id"))
    both = (pairs.join(found.select("rid", "id", "digest", "parts"), "rid")
            .join(items.select("item_id", "words"), "item_id"))
    out = both.mapInArrow(_cover(seed), "rid long, id long, digest long, item_id long, item_words long, "
                                        "covered_words long, n_tiles long")
    return out.where(F.col("covered_words") >= threshold * F.col("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """One row for each contaminated row of ``docs``: id, the items (smallest
    id first), and the highest coverage."""
    id_col = params.get("id_col", "doc_id")
    c = coverage(docs, benchmark, **params)
    return (c.groupBy("rid", F.col("id").alias(id_col))
            .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                 F.max(F.col("covered_words") / F.col("item_words")).alias("coverage"))
            .drop("rid"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text", **params) -> DataFrame:
    """The clean rows of ``docs``, each judged by its own text (rows are told
    apart by id, null included, and a hash of the text)."""
    bad = coverage(docs, benchmark, id_col=id_col, text_col=text_col, **params).select("id", "digest")
    return without(docs, bad, {"id": F.col(id_col).cast("long"), "digest": F.xxhash64(F.col(text_col).cast("string"))})
