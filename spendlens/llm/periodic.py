"""Periodic run detection (operator 11): suffix automaton with link-cut access.

A *run* is a stretch of words with smallest period ``q`` that neither neighbour
extends; runs of at least ``min_words`` words and ``min_periods`` periods are
reported, and the words after a run's first period can be dropped.

1. *Where to look.*  Every window of ``k`` words inside such a run comes again
   one period away, so a run lies in a stretch of consecutive windows that each
   occur twice or more in the stretch.  Stretches are found for a whole batch
   of texts by sorting window hashes; the rest of a text cannot hold a run.
   ``k`` is the largest width for which this holds (see ``_width``).
2. *Automaton.*  The suffix automaton of a stretch is built; its suffix links
   form a tree in which the path from a prefix's state to the root holds the
   suffixes of that prefix.
3. *Access.*  The words are appended one after the other, and the path of each
   prefix is accessed in a link-cut tree.  A preferred path has one colour: the
   end of the latest occurrence of its suffixes.  An access meets O(log n)
   coloured segments (amortised) and recolours them.  A segment of suffix
   lengths ``(lo, hi]`` with colour ``c`` met at end ``i`` holds the suffix of
   length ``d = i - c``, if ``lo < d <= hi``: it occurs at both ends, side by
   side, a square of period ``d``.  No later occurrence lies between, so the
   period is the smallest.
4. *Runs.*  A square that no known run of its period covers is extended to
   both sides word by word.

Nulls, empty texts and texts of fewer than ``min_words`` words have no run
(count 0, four nulls, digests of nothing or of their words); repeated rows give
equal rows; a null id stays null; other columns are not looked at.  A text is
worked on whole: the state of a task is one batch and the automaton of one
stretch (about 0.5 KB a word).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import chunks, mix, prepare, windows, words

_U = np.uint64


def _automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths, and the state of each prefix.  State 1 is the
    root; 0 is none."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, prefix = [0, 0], [0, 0], []
    last = 1
    for i, c in enumerate(text, 1):
        cur = len(link)
        step.append({})
        length.append(i)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(link)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        prefix.append(cur)
        last = cur
    return link, length, prefix


def _squares(text: list[int]):
    """``(end, period)`` of primitively rooted squares, ends from 1: each at
    every end where the latest earlier occurrence of its half is one period
    before."""
    link, length, prefix = _automaton(text)
    # Splay trees of preferred paths, by depth; ``up`` of a tree's root is the
    # path's parent in the link tree, ``colour`` of a tree's root its colour.
    up, left, right, colour = link, [0] * len(link), [0] * len(link), [0] * len(link)
    for i, x in enumerate(prefix, 1):
        below = hi = old = 0
        while x:
            # Splay x to the root of its tree.
            p = up[x]
            if p and (left[p] == x or right[p] == x):
                while p and (left[p] == x or right[p] == x):
                    g = up[p]
                    inner = g and (left[g] == p or right[g] == p)
                    if inner and (left[g] == p) == (left[p] == x):
                        _rotate(up, left, right, p, g)
                        _rotate(up, left, right, x, p)
                        top = g
                    elif inner:
                        _rotate(up, left, right, x, p)
                        _rotate(up, left, right, x, g)
                        top = g
                    else:
                        _rotate(up, left, right, x, p)
                        top = p
                    if not inner or not (up[x] and (left[up[x]] == x or right[up[x]] == x)):
                        colour[x] = colour[top]
                    p = up[x]
            if old and length[x] < i - old <= hi:
                yield i, i - old
            hi, old = length[x], colour[x]
            cut = right[x]
            if cut:
                colour[cut] = old
            right[x] = below
            below, x = x, up[x]
        if old and i - old <= hi:
            yield i, i - old
        colour[below] = i


def _rotate(up: list[int], left: list[int], right: list[int], x: int, p: int) -> None:
    """Lift ``x`` above its parent ``p`` inside a tree."""
    g = up[p]
    if left[p] == x:
        b = left[p] = right[x]
        right[x] = p
    else:
        b = right[p] = left[x]
        left[x] = p
    if b:
        up[b] = p
    up[p], up[x] = x, g
    if g:
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x


def runs_of(text: list[int], min_words: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence, by start and period."""
    out, ends, n = [], {}, len(text)
    for i, d in _squares(text):
        if i <= ends.get(d, 0):
            continue
        start, end = i - 2 * d, i
        while start and text[start - 1] == text[start - 1 + d]:
            start -= 1
        while end < n and text[end] == text[end - d]:
            end += 1
        ends[d] = end
        if end - start >= max(min_words, min_periods * d):
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _width(min_words: int, min_periods: int) -> int:
    """Largest window that comes again in any run: a run of ``L`` words and
    period ``q`` needs ``L >= 2q + k - 1`` for the windows of its middle, and
    ``L >= max(min_words, min_periods * q)``."""
    q = np.arange(1, min_words + 1)
    return int(max(1, (np.maximum(min_words, min_periods * q) - 2 * q + 1).min()))


def _stretches(h: np.ndarray, doc: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``least`` words or more in which
    every window of ``k`` words comes twice or more; ``doc`` numbers texts."""
    if len(h) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = windows(h, k)
    at = np.flatnonzero(doc[:len(gram)] == doc[k - 1:])
    part = doc[at].astype(np.int64)
    while len(at):
        key = mix(gram[at] + part.astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        now, of = at[twice], part[twice]
        new = np.append(True, (np.diff(now) > 1) | (np.diff(of) != 0))[:len(now)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(now)))
        keep = np.repeat(size >= least - k + 1, size)
        if keep.all() and len(now) == len(at):
            return now[first], now[first] + size + k - 1
        part = np.repeat(np.arange(len(first)), size)[keep]
        at = now[keep]
    return np.empty(0, np.int64), np.empty(0, np.int64)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Greatest length / period; ties: smallest start, then period."""
    top = runs[0]
    for r in runs[1:]:
        if r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


OUT = ("n_runs long, start long, length long, period long, exponent_milli long, "
       "runs_sha256 string, collapsed_sha256 string, collapsed binary, runs array<struct<start:long,length:long,period:long>>")


def _texts(min_words: int, min_periods: int, order, full: bool):
    """Rows of a batch: id, figures, digests; with ``full`` the collapsed text
    and the runs themselves."""
    k = _width(min_words, min_periods)

    def run(batches):
        for b in batches:
            ids, col = b.column(0).to_pylist(), b.column(1)
            rows = []
            for first, _, buf, offs in chunks(col):
                w = words(buf, offs, fold=False)
                cut = w.bounds()
                h = w.h
                moved: dict[int, np.ndarray] = {}
                if order:
                    h = h.copy()
                    for i in range(w.n_docs):
                        n = int(cut[i + 1] - cut[i])
                        if n and (to := order(ids[first + i], n)) is not None:
                            moved[i] = to
                            h[cut[i]:cut[i + 1]] = h[cut[i]:cut[i + 1]][to]
                found: dict[int, list] = {}
                for s, e in zip(*_stretches(h, w.doc, k, min_words), strict=True):
                    i = int(w.doc[s])
                    _, small = np.unique(h[s:e], return_inverse=True)
                    got = runs_of(small.tolist(), min_words, min_periods)
                    found.setdefault(i, []).extend((int(s - cut[i]) + a, n, q) for a, n, q in got)
                for i in range(w.n_docs):
                    own = buf[offs[i]:offs[i + 1]].tobytes().split()
                    rows.append(_row(ids[first + i], own, moved.get(i), sorted(found.get(i, []), key=lambda r: (r[0], r[2])), full))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate(_TYPES)], _NAMES)
    return run


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary(), _RUN]
_NAMES = ["id"] + [c.split(" ")[0] for c in OUT.split(", ")]


def _row(doc_id, own: list[bytes], to: np.ndarray | None, runs: list, full: bool) -> tuple:
    if to is not None:
        own = [own[j] for j in to.tolist()]
    if runs:
        gone = np.zeros(len(own) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        stay = np.cumsum(gone)[:-1] == 0
        own = [x for x, keep in zip(own, stay.tolist(), strict=True) if keep]
        s, n, q = _best(runs)
        best = (s, n, q, 1000 * n // q)
    else:
        best = (None,) * 4
    text = b" ".join(own)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
            text if full else None, [{"start": s, "length": n, "period": q} for s, n, q in runs] if full else None)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 24,
                  min_periods: int = 3, order=None, full: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``n_runs``, the run of the greatest
    exponent (``start, length, period, exponent_milli``), digests of the runs
    and of the text without repeated periods, and with ``full`` that text
    (``collapsed``) and the ``runs``.

    ``order(id, n)`` may give, for a text of ``n`` words, the word numbers that
    are to be read instead (None: as they are)."""
    if min_words < 3 or min_periods < 2:
        raise ValueError("a run has at least 3 words and 2 periods")
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_texts(min_words, min_periods, order, full), f"id long, {OUT}")
    out = out.withColumn("collapsed", F.col("collapsed").cast("string"))
    if not full:
        out = out.drop("collapsed", "runs")
    return out.withColumnRenamed("id", id_col)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word order of the query: with ``h`` the crc32 of the decimal id, a text
    whose ``h % 10`` is 0 is made periodic from word ``a`` on."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)
