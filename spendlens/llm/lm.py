"""LM scoring (operator 10): a causal self-attention model over subword ids,
trained in numpy; overlapping context windows score each token once.

A text is lower-cased (A-Z), split into words, and each word, behind a blank,
is cut by a public byte-level vocabulary; an end token closes the text.  The
model (one block: causal attention, a feed-forward layer, residuals) gives the
probability of a token's class from up to ``context`` tokens before it; inside
a class a token has its smoothed share of the class's training count.

* Counts: one pass over all texts counts the training texts' words and subwords
  and stores every text's subword ids and distinct words; no later step cuts
  a text again.
* Layout: classes and input buckets of about equal mass, from the counts of all
  training subwords.
* Training: a warm start on a bounded sample of training texts (``Params.sample``
  rows, by a hash of id) gives the first parameters; from them every task
  continues on every window of its stored ids; the tasks' parameters are
  averaged, weighted by windows.
* Scoring: windows of ``context`` positions advance by ``stride``; the last
  ``stride`` positions of a window are scored, so each token is scored once.

The base score is an add-one unigram model over words.  The most frequent words
are looked up in a table of bounded size that every task gets; the others are
joined by hash, so no vocabulary has to fit anywhere.

Null and empty texts are the end token alone.  A null id trains (its remainder
is not the held-out one).  Repeated rows count and are scored each.  Without
training texts, counts are 0 and all classes are equally likely.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import prepare, chunks, crc_mod, stored, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose words are encoded together.
TOGETHER = 2 << 20
#: Bytes of stored ids and words that a task holds of a file, and rows of counts that it sends on at once.
ROW_GROUP, COUNTS_TOGETHER = 16 << 20, 1 << 16
#: Windows that are scored together.
SCORED_TOGETHER = 512
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Params:
    dim: int = 8
    classes: int = 32
    buckets: int = 512
    context: int = 24
    stride: int = 16
    sample: int = 600
    steps: int = 400
    batch: int = 256
    rate: float = 0.01
    smoothing: float = 0.1
    hot_words: int = 400_000
    seed: int = 11


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


@lru_cache(maxsize=2)
def _starts_word(path: str) -> np.ndarray:
    """Which ids begin with a blank."""
    enc, end = _encoding(path)
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(end)])


def _at_once(text: bytes, n: int, path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Number of subwords of each of ``n`` words, all behind a blank, and their
    ids in order; nothing where the words cannot be told apart.  They are cut in
    one call: no piece of the split crosses the blank before a word, and only a
    word's first subword begins with one."""
    flat = np.array(_encoding(path)[0].encode_ordinary(text.decode("utf-8", "replace")), np.int32)
    begin = np.flatnonzero(_starts_word(path)[flat])
    return None if len(begin) != n or begin[0] else (np.diff(np.append(begin, len(flat))), flat)


def encoded(own: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of subwords of each word, behind a blank, and their ids in order."""
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    got = _at_once(b" " + b" ".join(own), len(own), path)
    if got is None:
        enc, _ = _encoding(path)
        each = [enc.encode_ordinary(" " + x.decode("utf-8", "replace")) for x in own]
        size = np.fromiter(map(len, each), np.int64, len(each))
        got = size, np.fromiter(chain.from_iterable(each), np.int32, int(size.sum()))
    return got


def _encoded_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``encoded`` of the words ``buf[start:end]``, lower-cased (A-Z)."""
    size = end - start + 1
    to = np.cumsum(size) - size
    text = LOWER[buf[np.arange(size.sum()) + np.repeat(start - 1 - to, size)]]
    text[to] = 0x20
    got = _at_once(text.tobytes(), len(size), path) if len(size) else None
    return got or encoded([text[a + 1:a + n].tobytes() for a, n in zip(to.tolist(), size.tolist(), strict=True)], path)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of their first places, these places, and the
    number of its value at every place (by hash: nothing is sorted)."""
    coded = pa.array(h).dictionary_encode()
    of = coded.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1)) if len(of) else np.empty(0, np.int64)
    return coded.dictionary.to_numpy(), first, of


class Tokens:
    """Subword ids of consecutive texts, each closed by the end token, and
    their distinct words with counts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, path: str):
        end = _encoding(path)[1]
        w = words(buf, offs)
        self.n = w.n_docs
        self.at = w.bounds()
        self.word, first, self.of = distinct(w.h)
        size, flat = _encoded_of(buf, w.start[first], w.end[first], path)
        begin = np.cumsum(size) - size
        each = size[self.of]
        self.doc_words = w.doc
        length = np.bincount(w.doc, weights=each, minlength=self.n).astype(np.int64) + 1
        self.start = np.cumsum(length) - length
        self.length = length
        del w
        self.ids = np.full(int(length.sum()), end, np.int32)
        if len(each):
            # Tokens go in order to all places but the texts' last ones.
            of = np.repeat(begin[self.of] - (np.cumsum(each) - each), each)
            of += np.arange(len(of))
            inside = np.ones(len(self.ids), bool)
            inside[self.start + length - 1] = False
            self.ids[inside] = flat[of]


def token_stream(text: pa.Array, path: str):
    for first, _, buf, offs in chunks(text, TOGETHER):
        yield first, Tokens(buf, offs, path)


@dataclass
class Layout:
    """Class and input bucket of every id; the last id is the end token."""

    cls: np.ndarray
    bucket: np.ndarray


def layout(counts: np.ndarray, starts_word: np.ndarray, p: Params) -> Layout:
    """Ids by (begins a word, frequency), cut into groups of equal mass; the
    end token has a class and a bucket of its own."""
    v = len(counts) - 1
    order = np.lexsort((np.arange(v), -counts[:v], ~starts_word))
    mass = np.cumsum(counts[:v][order] + 1e-3)

    def cut(k):
        g = np.empty(v + 1, np.int64)
        # Groups split at the change from word starts to continuations as well.
        first = int(starts_word.sum())
        share = mass[first - 1] / mass[-1] if 0 < first < v else 1.0
        left = min(max(1, round(share * (k - 1))), k - 2)
        for ids, total, base, n in ((order[:first], mass[:first], 0, left),
                                    (order[first:], mass[first:] - (mass[first - 1] if first else 0), left, k - 1 - left)):
            if len(ids):
                g[ids] = base + np.minimum((total - total[0]) * n // total[-1], n - 1).astype(np.int64)
        g[v] = k - 1
        return g
    return Layout(cut(p.classes), cut(p.buckets).astype(np.uint16 if p.buckets <= 1 << 16 else np.int64))


def initial(p: Params) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    d = p.dim
    shapes = {"embed": (p.buckets, d), "place": (p.context, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d),
              "w1": (d, 4 * d), "w2": (4 * d, d), "out": (d, p.classes), "bias": (p.classes,)}
    return {k: (rng.normal(0, 0.3 if k in ("embed", "place") else s[0] ** -0.5, s) if k != "bias" else np.zeros(s))
            .astype(np.float32) for k, s in shapes.items()}


def _flags(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """``n`` flags, set from each ``begin`` on for its ``length`` (1 or more)."""
    step = np.zeros(n + 1, np.int8)
    step[begin] += 1
    step[begin + length] -= 1
    return np.cumsum(step[:n], dtype=np.int8, out=step[:n]).view(bool)


class Windows:
    """Overlapping windows over consecutive texts.  Position ``t`` of a text
    reads the token before it (the end token for the first)."""

    def __init__(self, start: np.ndarray, length: np.ndarray, p: Params):
        n = -(-length // p.stride)
        self.text = np.repeat(np.arange(len(length)), n)
        self.p, self.before, self.start = p, p.context - p.stride, start
        self.causal = np.where(np.arange(p.context) - self.before <= np.arange(p.stride)[:, None], 0, -1e9).astype(np.float32)
        # Texts lie one after another, each filled up to whole strides; ahead
        # of it lies what its first window reads before its first position.
        self.rows = len(self.text)
        self.first = np.arange(self.rows) * p.stride + self.text * self.before
        # Places of tokens as flags of a byte, in order of the texts.
        begin = (np.cumsum(n) - n) * p.stride
        self.own = _flags(begin, length, self.rows * p.stride)
        self.read = _flags(begin + np.arange(1, len(length) + 1) * self.before, length,
                           max(p.context, self.rows * p.stride + len(length) * self.before))

    def over(self, ids: np.ndarray, end, targets: np.ndarray | None = None):
        """A function of window numbers that gives their inputs (windows,
        context), masks of keys, and of scored positions, and targets (windows,
        stride), taken from ``targets`` (``ids`` if None)."""
        view, p = np.lib.stride_tricks.sliding_window_view, self.p
        targets = ids if targets is None else targets
        x = np.full(len(self.read), end, np.result_type(ids, np.min_scalar_type(end)))
        last = np.empty_like(x, shape=len(ids))
        last[1:], last[self.start] = ids[:-1], end
        x[self.read] = last
        y = np.zeros(len(self.own), targets.dtype)
        y[self.own] = targets
        x, read = view(x, p.context), view(self.read, p.context)
        y, scored = y.reshape(-1, p.stride), self.own.reshape(-1, p.stride)
        mask = np.array([-1e9, 0], np.float32)
        return lambda pick: (x[self.first[pick]], mask.take(read[self.first[pick]].view(np.uint8)), scored[pick], y[pick])

    def take(self, pick, ids: np.ndarray, end, targets: np.ndarray | None = None):
        return self.over(ids, end, targets)(pick)


#: Sums of powers within these bounds need no row maximum taken off before ``exp``.
LEAST, MOST = 1e-20, 1e20


@lru_cache(maxsize=8)
def _filled(value: float, shape: tuple, dtype) -> np.ndarray:
    out = np.full(shape, value, dtype)
    out.flags.writeable = False
    return out


def _within(sums: np.ndarray) -> bool:
    return not sums.size or bool(sums.min() > LEAST and sums.max() < MOST)


def _wide(t: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), t.dtype)
    out[:t.shape[0], :t.shape[1]] = t
    return out


def _joined(m: dict, d: int):
    """Products of parameters that meet no value between them, with a last
    column and row: an input's last value is 1 (0 if masked), so that sums and
    the bias come with the products."""
    embed = _wide(m["embed"], len(m["embed"]), d + 1)
    embed[:, d] = 1
    qk = (m["q"] * m["q"].dtype.type(d ** -0.5)) @ m["k"].T
    return (embed, _wide(m["place"], len(m["place"]), d + 1), _wide(qk, d + 1, d + 1), _wide(m["v"] @ m["o"], d + 1, d + 1),
            _wide(m["w1"], d + 1, 4 * d), _wide(m["w2"], 4 * d, d + 1), np.concatenate([m["out"], m["bias"][None]]))


def logits(m: dict, x: np.ndarray, keys: np.ndarray, causal: np.ndarray, p: Params):
    """Logits of classes, a row for each of the last ``stride`` positions of
    each window, the logarithms of their sums of powers, and what the gradient
    needs.  Queries meet keys, and values the output, in one product each
    (``q k'`` and ``v o``); weights of keys stay undivided, their sum is the
    last column of their product with the inputs."""
    s, d, (b, n) = p.stride, p.dim, x.shape
    embed, place, qk, vo, w1, w2, last = joined = _joined(m, d)
    e = embed.take(x, 0)
    e += place
    eq = e[:, -s:].reshape(-1, d + 1)
    gone = np.flatnonzero(keys.ravel() < 0)
    e.reshape(-1, d + 1)[gone] = 0
    q, seen = (eq @ qk).reshape(b, s, d + 1), e.transpose(0, 2, 1)
    a = q @ seen
    a += causal
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        c = (a @ e).reshape(-1, d + 1)
    if not _within(c[:, d]):
        a = q @ seen
        a += causal
        a += keys[:, None, :]
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        c = (a @ e).reshape(-1, d + 1)
    inv = 1 / c[:, d:]
    c *= inv
    h = c @ vo
    h += eq
    r = h @ w1
    np.maximum(r, _filled(0, r.shape, r.dtype), out=r)
    g = r @ w2
    g += h
    z = g @ last
    ones = _filled(1, (p.classes,), z.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        share = np.exp(z)
        total = share @ ones
    if not _within(total):
        z -= z.max(-1, keepdims=True)
        share = np.exp(z)
        total = share @ ones
    return z, np.log(total), (e, gone, eq, q, a, inv, c, h, r, g, share, total, joined)


def forward(m: dict, x: np.ndarray, keys: np.ndarray, causal: np.ndarray, p: Params):
    """Log-probabilities of classes at the last ``stride`` positions, and what
    the gradient needs."""
    z, total, kept = logits(m, x, keys, causal, p)
    z -= total[:, None]
    return z.reshape(len(x), p.stride, -1), kept


def gradient(m: dict, x: np.ndarray, z: np.ndarray, kept, y: np.ndarray, scored: np.ndarray, p: Params) -> dict:
    """Gradient of the mean negative log-probability of classes ``y``; uses up
    ``kept``."""
    e, gone, eq, q, a, inv, c, h, r, g, share, total, (embed, _, qk, vo, w1, w2, last) = kept
    s, d, (b, n) = p.stride, p.dim, x.shape
    each = lambda t: t.reshape(b, -1, t.shape[-1])
    # Rows of dz lack their factor ``by``, which goes to the narrow products.
    by = (scored.ravel() / (max(1, scored.sum()) * total)).astype(z.dtype)[:, None]
    dz = share
    dz.reshape(-1)[np.arange(b * s) * p.classes + y.ravel()] -= total
    g *= by
    dlast = g.T @ dz
    dg = dz @ last.T
    dg *= by
    du = dg @ w2.T
    du *= r > 0
    dh = du @ w1.T
    dh += dg
    dvo = (c.T @ dh)[:d, :d]
    # The last column takes off a row's mean of da, the product of dc and c.
    dc = dh @ vo.T
    dc[:, d] = -((dc * c) @ _filled(1, (d + 1,), z.dtype))
    dc *= inv
    da = each(dc) @ e.transpose(0, 2, 1)
    da *= a
    dq = (da @ e).reshape(-1, d + 1)
    dqk = (eq.T @ dq)[:d, :d] * z.dtype.type(d ** -0.5)
    de = a.transpose(0, 2, 1) @ each(dc)
    de += da.transpose(0, 2, 1) @ q
    dh += dq @ qk.T
    de[:, -s:] += each(dh)
    de.reshape(-1, d + 1)[gone] = 0
    order = np.argsort(x, axis=None, kind="stable")
    of = x.ravel()[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    dembed = np.zeros_like(embed)
    dembed[of[first]] = np.add.reduceat(de.reshape(-1, d + 1).take(order, 0), first)
    return {"embed": dembed[:, :d], "place": de.sum(0)[:, :d], "q": dqk @ m["k"], "k": dqk.T @ m["q"],
            "v": dvo @ m["o"].T, "o": m["v"].T @ dvo, "w1": (h.T @ du)[:d], "w2": (r.T @ dg)[:, :d],
            "out": dlast[:d], "bias": dlast[d]}


class Adam:
    """Steps over all parameters as one vector, of which ``m`` has the views."""

    def __init__(self, m: dict, rate: float):
        self.rate, self.t = rate, 0
        self.all = np.concatenate([v.ravel() for v in m.values()])
        cuts = np.cumsum([v.size for v in m.values()])[:-1]
        self.m = {k: x.reshape(v.shape) for (k, v), x in zip(m.items(), np.split(self.all, cuts), strict=True)}
        self.a, self.b = np.zeros_like(self.all), np.zeros_like(self.all)

    def step(self, d: dict) -> None:
        self.t += 1
        fix = self.rate * (1 - 0.99 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        g = np.concatenate([d[k].ravel() for k in self.m])
        self.a += 0.1 * (g - self.a)
        self.b += 0.01 * (g * g - self.b)
        self.all -= (fix * self.a / (np.sqrt(self.b) + 1e-8)).astype(np.float32)


def learn(opt: Adam, w: Windows, picks, ids: np.ndarray, lay: Layout, end: int, p: Params) -> None:
    take = w.over(lay.bucket[ids], lay.bucket[end], lay.cls.astype(np.min_scalar_type(p.classes))[ids])
    for pick in picks:
        x, keys, scored, y = take(pick)
        z, _, kept = logits(opt.m, x, keys, w.causal, p)
        opt.step(gradient(opt.m, x, z, kept, y, scored, p))


def warm_start(texts: list[np.ndarray], starts_word: np.ndarray, p: Params,
               counts: np.ndarray | None = None) -> tuple[Layout, dict]:
    """Layout from ``counts`` of all ids (those of ``texts`` if None), and first
    parameters from the sample's token ids."""
    end = len(starts_word)
    ids = np.concatenate(texts) if texts else np.empty(0, np.int32)
    lay = layout(np.bincount(ids, minlength=end + 1).astype(float) if counts is None else counts, starts_word, p)
    m = initial(p)
    if len(ids):
        length = np.array([len(t) for t in texts])
        w = Windows(np.cumsum(length) - length, length, p)
        rng = np.random.default_rng(p.seed)
        opt = Adam(m, p.rate)
        learn(opt, w, (rng.integers(0, len(w.text), p.batch) for _ in range(p.steps)), ids, lay, end, p)
        m = opt.m
    return lay, m


def _pack(m: dict) -> bytes:
    return b"".join(m[k].astype("<f4").tobytes() for k in sorted(m))


def _unpack(x: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sample_ids(path: str):
    def run(batches):
        for b in batches:
            rows = []
            for _, t in token_stream(b.column("text"), path):
                rows += [t.ids[s:s + n] for s, n in zip(t.start, t.length, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("order"), pa.array(rows, pa.list_(pa.int32()))], ["order", "ids"])
    return run


_GATHERED = "kind int, key long, n long, data binary, words binary, rid "
#: A distinct word of a text: its hash and how often it comes.
_WORD = np.dtype([("key", "<i8"), ("n", "<i4")])


def _stored_id(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<i4"


def _rows(kind, key, n, data=None, own=None, rid=None, rid_type=None):
    none = pa.nulls(len(n), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(n))), pa.array(np.broadcast_to(np.asarray(key, np.int64), len(n))),
         pa.array(np.asarray(n, np.int64)), none if data is None else pa.array(data, pa.binary()),
         none if own is None else pa.array(own, pa.binary()), pa.nulls(len(n), rid_type) if rid is None else rid],
        ["kind", "key", "n", "data", "words", "rid"])


def _cuts(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The bytes of consecutive runs of ``size`` values."""
    raw, ends = flat.tobytes(), (np.cumsum(size) * flat.itemsize).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _gather(path: str, end: int):
    """Per task: counts of words (kind 0), of subwords (kind 1), number of
    texts (kind 2), all of training texts; and every text's number of subwords,
    their ids and its distinct words (kind 3; 4 if it is held out)."""
    def merged(parts):
        key = np.concatenate([k for k, _ in parts])
        n = np.concatenate([n for _, n in parts])
        key, of = np.unique(key, return_inverse=True)
        n = np.bincount(of, weights=n).astype(np.int64)
        return [(key[i:i + COUNTS_TOGETHER], n[i:i + COUNTS_TOGETHER]) for i in range(0, len(key), COUNTS_TOGETHER)]

    def run(batches):
        sub, texts, parts, held, kind = np.zeros(end + 1, np.int64), 0, [], 0, None
        for b in batches:
            out, kind = b.column("held_out").to_numpy(zero_copy_only=False), b.column("rid").type
            for at, t in token_stream(b.column("text"), path):
                mine = ~out[at:at + t.n].astype(bool)
                n = np.bincount(t.of[mine[t.doc_words]], minlength=len(t.word))
                some = np.flatnonzero(n)
                parts.append((t.word[some].view(np.int64), n[some]))
                held += len(some)
                if held > 1_500_000:
                    yield from (_rows(0, *some, rid_type=kind) for some in merged(parts))
                    parts, held = [], 0
                sub += np.bincount(t.ids[np.repeat(mine, t.length)], minlength=end + 1)
                texts += int(mine.sum())
                pair, first, of = distinct(t.doc_words * len(t.word) + t.of)
                own = np.empty(len(pair), _WORD)
                own["key"], own["n"] = t.word[t.of[first]].view(np.int64), np.bincount(of, minlength=len(pair))
                yield _rows(np.where(mine, 3, 4), 0, t.length, _cuts(t.ids.astype(_stored_id(end)), t.length),
                            _cuts(own, np.bincount(t.doc_words[first], minlength=t.n)), b.column("rid").slice(at, t.n))
        if parts:
            yield from (_rows(0, *some, rid_type=kind) for some in merged(parts))
        if texts:
            some = np.flatnonzero(sub)
            yield _rows(1, some, sub[some], rid_type=kind)
            yield _rows(2, 0, [texts], rid_type=kind)
    return run


def gathered(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The stored rows of ``_gather`` over ``(rid, held_out, text)``: texts are
    cut into words and subwords once, for the counts, training and scoring."""
    prepare(rows.sparkSession)
    schema = _GATHERED + rows.schema["rid"].dataType.simpleString()
    return stored(rows.select("rid", "held_out", "text").mapInArrow(_gather(path, _encoding(path)[1]), schema), ROW_GROUP)


def _fit(lay: Layout, m: dict, p: Params):
    """Per task: the number of windows it learns from, and the parameters it
    ends with."""
    def run(batches):
        end, learnt = len(lay.cls) - 1, 0
        opt = Adam({k: v.copy() for k, v in m.items()}, p.rate / 4)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("data").to_pylist()), _stored_id(end))
            length = b.column("n").to_numpy()
            w = Windows(np.cumsum(length) - length, length, p)
            mine = np.random.default_rng(p.seed).permutation(len(w.text))
            learn(opt, w, (mine[i:i + p.batch] for i in range(0, len(mine), p.batch)), ids, lay, end, p)
            learnt += len(mine)
        if learnt:
            yield pa.RecordBatch.from_arrays([pa.array([learnt], pa.int64()), pa.array([_pack(opt.m)], pa.binary())],
                                             ["n", "params"])
    return run


def _mean_params(pdf):
    import pandas as pd
    n = pdf["n"].to_numpy(np.float64)
    x = np.stack([np.frombuffer(b, "<f4").astype(np.float64) * k for b, k in zip(pdf["params"], n, strict=True)]).sum(0)
    return pd.DataFrame({"n": [int(n.sum())], "params": [(x / n.sum()).astype("<f4").tobytes()]})


@dataclass
class Model:
    path: str
    params: Params
    layout: Layout
    weights: dict
    within: np.ndarray
    hot: np.ndarray
    hot_count: np.ndarray
    n_train: int
    n_distinct: int
    n_texts: int
    n_windows: int = 0


def train(rows: DataFrame, *, path: str = VOCABULARY, params: Params | None = None,
          got: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """From training rows ``(id, text)``: the model, and ``(key, n)`` of all
    words that are not in its table of frequent words.  ``got`` is what
    ``gathered`` has stored of them."""
    p = params or Params()
    prepare(rows.sparkSession)
    end = _encoding(path)[1]
    starts = _starts_word(path)
    order = F.xxhash64(F.col("id").cast("string"))
    # ``sample`` ids at most, and of rows that repeat one the smallest text.
    chosen = rows.select("id").distinct().orderBy(order, "id").limit(p.sample)
    pick = (rows.join(F.broadcast(chosen.withColumnRenamed("id", "chosen")), F.col("id").eqNullSafe(F.col("chosen")))
            .groupBy("id").agg(F.min("text").alias("text")).select(order.alias("order"), "text"))
    texts = pick.mapInArrow(_sample_ids(path), "order long, ids array<int>").orderBy("order").toArrow().to_pydict()["ids"]

    if got is None:
        got = gathered(rows.select(F.col("id").alias("rid"), F.lit(False).alias("held_out"), "text"), path)
    sums = got.where("kind < 3").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stored(sums)
    sub = np.zeros(end + 1)
    for r in counts.where("kind = 1").collect():  # one row an id of the vocabulary at most
        sub[r.key] = r.n
    total = counts.where("kind = 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_texts = sum(r.n for r in counts.where("kind = 2").collect())
    lay, m = warm_start([np.array(t, np.int32) for t in texts], starts, p, sub)
    # A task for each file, however many row groups it has.  Parameters meet in two steps, a few hundred tasks at a time.
    fitted = (got.where("kind = 3").select("n", "data").coalesce(max(1, len(got.inputFiles())))
              .mapInArrow(_fit(lay, m, p), "n long, params binary"))
    some = fitted.select("n", "params", F.pmod(F.xxhash64("params"), F.lit(64)).alias("g"))
    mean = some.groupBy("g").applyInPandas(_mean_params, "n long, params binary")
    mean = mean.groupBy(F.lit(0).alias("g")).applyInPandas(_mean_params, "n long, params binary").collect()
    weights = _unpack(np.frombuffer(mean[0].params, "<f4"), m) if mean else m

    mass = np.bincount(lay.cls, weights=sub + p.smoothing, minlength=p.classes)
    within = np.log((sub + p.smoothing) / mass[lay.cls])
    # Frequent words: the highest power-of-two step of counts that the table can hold.
    word = counts.where("kind = 0").select("key", "n")
    steps = {int(r.b): r.v for r in word.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("v")).collect()}
    least, held = 64, 0
    for b in sorted(steps, reverse=True):
        if held + steps[b] > p.hot_words:
            break
        held, least = held + steps[b], b
    hot = word.where(F.floor(F.log2("n")) >= least).toPandas()
    key = hot["key"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(key)
    model = Model(path, p, lay, weights, within, key[by], hot["n"].to_numpy(np.int64)[by],
                  int(total.n or 0) + n_texts, int(total.v) + (n_texts > 0), n_texts,
                  mean[0].n if mean else 0)
    return model, word.where(F.floor(F.log2("n")) < least)


def log10_probability(t: Tokens | Subwords, m: Model) -> np.ndarray:
    """The model's log10 probability of every text."""
    p, end = m.params, len(m.layout.cls) - 1
    w = Windows(t.start, t.length, p)
    take = w.over(m.layout.bucket[t.ids], m.layout.bucket[end], m.layout.cls.astype(np.min_scalar_type(p.classes))[t.ids])
    sums = np.zeros(len(w.text))
    for lo in range(0, len(w.text), SCORED_TOGETHER):
        pick = slice(lo, lo + SCORED_TOGETHER)
        x, keys, scored, y = take(pick)
        z, log_sum, _ = logits(m.weights, x, keys, w.causal, p)
        own = (z.reshape(-1)[np.arange(len(z)) * p.classes + y.ravel()] - log_sum).reshape(y.shape)
        sums[pick] = np.where(scored, own, 0).sum(1, dtype=float)
    total = np.bincount(w.text, weights=sums, minlength=t.n)
    total += np.add.reduceat(m.within[t.ids], t.start) if t.n else 0.0
    return total / np.log(10)


_SCORED = ("rid long, n_tokens long, known long, log_sum double, score double, "
           "rare array<struct<key:long,n:int>>")


@dataclass
class Subwords:
    """Subword ids of consecutive texts, as they were stored."""

    ids: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        self.n, self.start = len(self.length), np.cumsum(self.length) - self.length


def _score(m: Model):
    def run(batches):
        end = len(m.layout.cls) - 1
        for b in batches:
            t = Subwords(np.frombuffer(b"".join(b.column("data").to_pylist()), _stored_id(end)), b.column("n").to_numpy())
            each = b.column("words").to_pylist()
            own = np.frombuffer(b"".join(each), _WORD)
            doc = np.repeat(np.arange(t.n), np.fromiter(map(len, each), np.int64, t.n) // _WORD.itemsize)
            key, times = np.ascontiguousarray(own["key"]), np.ascontiguousarray(own["n"])
            word, _, of = distinct(key.view(np.uint64))
            at = np.minimum(np.searchsorted(m.hot, word), max(0, len(m.hot) - 1))
            hit = m.hot[at] == word if len(m.hot) else np.zeros(len(word), bool)
            count = np.where(hit, m.hot_count[at] if len(m.hot) else 0, 0)
            total = lambda x: np.bincount(doc, weights=x, minlength=t.n)  # noqa: E731, B023
            # The other words, once for each text, with their number.
            miss = np.flatnonzero(~hit[of])
            ends = np.append(0, np.cumsum(np.bincount(doc[miss], minlength=t.n)))
            rare = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(key[miss]), pa.array(times[miss])], ["key", "n"]))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), pa.array(total(times).astype(np.int64) + 1),
                 pa.array(total(hit[of] * times).astype(np.int64) + (m.n_texts > 0)),
                 pa.array(total(np.log10(count + 1.0)[of] * times) + np.log10(m.n_texts + 1.0)),
                 pa.array(log10_probability(t, m)), rare],
                [f.split()[0] for f in ("rid", "n_tokens", "known", "log_sum", "score", "rare")])
    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2,
              path: str = VOCABULARY, params: Params | None = None) -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every row; rows whose crc32 of the id
    leaves ``held`` modulo ``mod`` are not trained on."""
    out_of = F.coalesce(crc_mod(id_col, mod) == held, F.lit(False))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), out_of.alias("held_out"))
    rid = F.struct(F.monotonically_increasing_id().alias("r"), "id", "held_out").alias("rid")
    got = gathered(src.select(rid, "held_out", "text"), path)
    model, rare = train(src.where(~F.col("held_out")).select("id", "text"), path=path, params=params, got=got)
    schema = _SCORED.replace("rid long", f"rid {got.schema['rid'].dataType.simpleString()}")
    texts = got.where("kind >= 3").select("rid", "n", "data", "words")
    scored = stored(texts.mapInArrow(_score(model), schema).select("rid.*", *[c for c in (
        "n_tokens", "known", "log_sum", "score", "rare")]))
    words_of = scored.select("r", F.inline("rare"))
    rest = (words_of.join(rare.select("key", F.col("n").alias("c")), "key")
            .groupBy("r").agg(F.sum("n").alias("known_too"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log_too")))
    unit = float(np.log10(model.n_train + model.n_distinct + 1.0))
    return (scored.drop("rare").join(rest, "r", "left")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("known_too", F.lit(0))).alias("n_known"),
                    F.lit(model.n_train).cast("long").alias("train_tokens"),
                    (F.col("log_sum") + F.coalesce("log_too", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"),
                    "score"))
