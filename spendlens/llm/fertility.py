"""Quality rules by tokeniser fertility (operator 4).

A public vocabulary is a yardstick: text of a language it knows takes few
tokens, while random strings, wrong encodings and symbol soup fall apart into
short pieces or bytes.  For each text, over its words (each encoded as the word
after a blank):

* ``chars_per_token``: code points in words by tokens of a byte-fallback
  vocabulary, and by tokens of a second, byte-level one;
* ``byte_share``: tokens of the first vocabulary that are single bytes;
* ``token_entropy``: Shannon entropy (bits) of the token distribution, by the
  largest that as many tokens could have, ``log2(min(tokens, vocabulary))``.

A text is rejected if a measure leaves the band of its language, or else of
its dominant script (told by UTF-8 lead bytes), or else the general one.

Base rules count words, code points in words, symbols, repeated lines and words
inside repeated windows of ``window`` words.  Every distinct word of a batch
is encoded once.  Null and empty texts have no words and fail the base rule.
The vocabulary files must be at the same path on every executor.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import prepare, chunks, windows, words

VOCABULARIES = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose words are encoded together.
TOGETHER = 4 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: The split before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Scripts by lead byte: first byte of each range, in order.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "semitic", "brahmic", "kana", "han", "hangul", "other")
_LEAD = np.zeros(256, np.int64)
for _first, _end, _script in ((0x41, 0x5B, "latin"), (0x61, 0x7B, "latin"), (0xC3, 0xCB, "latin"),
                              (0xCD, 0xD0, "greek"), (0xD0, 0xD5, "cyrillic"), (0xD6, 0xDD, "semitic"),
                              (0xE0, 0xE1, "brahmic"), (0xE1, 0xE2, "other"), (0xE3, 0xE4, "kana"),
                              (0xE4, 0xEA, "han"), (0xEA, 0xEE, "hangul"), (0xF0, 0xF5, "other")):
    _LEAD[_first:_end] = SCRIPTS.index(_script)


@dataclass(frozen=True)
class Band:
    """Lowest and highest code points a token (of either vocabulary), highest
    byte share, and lowest and highest relative token entropy of texts to keep."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float
    entropy_high: float = 1.0


#: Wide bands: alphabets take 1.2 to 8 code points a token, scripts that the
#: vocabularies know badly are mostly bytes (up to three for a code point).
BANDS = {
    "latin": Band(1.65, 8.0, 0.10, 0.40),
    "greek": Band(0.5, 6.0, 0.60, 0.30),
    "cyrillic": Band(0.9, 6.0, 0.25, 0.30),
    "semitic": Band(0.4, 5.0, 0.70, 0.30),
    "brahmic": Band(0.25, 4.0, 1.00, 0.20),
    "kana": Band(0.3, 3.0, 0.90, 0.25),
    "han": Band(0.3, 3.0, 0.95, 0.25),
    "hangul": Band(0.25, 3.0, 1.00, 0.20),
    "other": Band(0.2, 8.0, 1.00, 0.20),
    "none": Band(0.2, 8.0, 1.00, 0.20),
}


@lru_cache(maxsize=4)
def _pieces(folder: str):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


@lru_cache(maxsize=4)
def _bytes(folder: str):
    import tiktoken
    with open(f"{folder}/{BYTES}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _repeated(h: np.ndarray, window: int) -> int:
    """Words inside windows that occur twice or more."""
    g = windows(h, window)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    if not same.any():
        return 0
    twice = order[np.append(same, False) | np.append(False, same)]
    cover = np.zeros(len(h) + 1, np.int64)
    cover[twice] += 1
    np.subtract.at(cover, twice + window, 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _measures(text: pa.Array, folder: str, window: int):
    """Arrays of the measures of every text."""
    sp, is_byte = _pieces(folder)
    byte_level = _bytes(folder)
    out: dict[str, list] = {k: [] for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_bytes",
        "n_byte_level", "entropy", "script")}
    for _, _, buf, offs in chunks(text, TOGETHER):
        w = words(buf, offs, fold=False)
        n, at = w.n_docs, w.bounds()
        starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        count = np.diff(at)
        chars = starts[w.end] - starts[w.start]
        out["n_words"].append(count)
        out["word_chars"].append(np.bincount(w.doc, weights=chars, minlength=n).astype(np.int64))
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
        out["n_symbols"].append(symbols[offs[1:]] - symbols[offs[:-1]])
        dup, rep = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = buf.tobytes()
        for i in range(n):
            lines = [x for x in raw[offs[i]:offs[i + 1]].split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
            rep[i] = _repeated(w.h[at[i]:at[i + 1]], window)
        out["n_dup_lines"].append(dup)
        out["n_repeat_words"].append(rep)
        doc = np.repeat(np.arange(n), np.diff(offs))
        seen = np.bincount(doc * len(SCRIPTS) + _LEAD[buf], minlength=n * len(SCRIPTS)).reshape(n, -1)
        seen[:, 0] = 0
        out["script"].append(np.where(seen.sum(1) > 0, seen.argmax(1), 0))

        u, first, of = np.unique(w.h, return_index=True, return_inverse=True)
        own = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        ids = sp.encode(own, num_threads=1) if own else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        fallback = np.concatenate([[0], np.cumsum(is_byte[flat])])
        other = np.fromiter((len(byte_level.encode_ordinary(" " + x)) for x in own), np.int64, len(own))
        per = lambda x: np.bincount(w.doc, weights=x[of] if len(x) else [], minlength=n).astype(np.int64)
        tokens = per(size)
        out["n_tokens"].append(tokens)
        out["n_bytes"].append(per(fallback[begin + size] - fallback[begin]))
        out["n_byte_level"].append(per(other))
        # Every token of every word, as (text, id): the distribution of each text.
        each = size[of]
        key = (np.repeat(w.doc, each) * len(is_byte)
               + flat[np.repeat(begin[of] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
        k, c = np.unique(key, return_counts=True)
        held = np.bincount(k // len(is_byte), weights=c * np.log2(c), minlength=n)
        some = np.maximum(tokens, 1)
        out["entropy"].append(np.log2(some) - held / some)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}, len(is_byte)


_FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "chars_per_token double, chars_per_byte_token double, byte_share double, token_entropy double, "
           "script string, base_failed boolean, kept boolean")


def _rules(folder: str, window: int, least_words: int, repeat_share: int, bands: dict[str, Band]):
    def run(batches):
        for b in batches:
            x, vocabulary = _measures(b.column("text"), folder, window)
            some = np.maximum(x["n_tokens"], 1)
            cpt, cpb = x["word_chars"] / some, x["word_chars"] / np.maximum(x["n_byte_level"], 1)
            share = x["n_bytes"] / some
            entropy = np.where(some > 1, x["entropy"] / np.log2(np.clip(some, 2, vocabulary)), 0.0)
            script = [SCRIPTS[i] for i in x["script"]]
            band = [bands.get(lang) or bands.get(s) or bands["other"] for lang, s in
                    zip(b.column("lang").to_pylist(), script, strict=True)]
            low, high, most, e_low, e_high = (np.array([getattr(r, f) for r in band]) for f in (
                "chars_low", "chars_high", "bytes_high", "entropy_low", "entropy_high"))
            failed = (x["n_words"] < least_words) | (100 * x["n_repeat_words"] > repeat_share * x["n_words"])
            inside = ((cpt >= low) & (cpt <= high) & (cpb >= low) & (cpb <= high) & (share <= most)
                      & (entropy >= e_low) & (entropy <= e_high))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(x[k], pa.int64()) for k in (
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 *(pa.array(v, pa.float64()) for v in (cpt, cpb, share, entropy)), pa.array(script),
                 pa.array(failed), pa.array(~failed & inside)],
                ["id", *(f.split()[0] for f in _FIELDS.split(", "))])
    return run


def fertility_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                    vocabularies: str = VOCABULARIES, window: int = 8, least_words: int = 20, repeat_share: int = 30,
                    bands: dict[str, Band] | None = None) -> DataFrame:
    """id, base counts, fertility measures, ``base_failed`` and ``kept`` of
    every row.  ``bands`` adds to or replaces ``BANDS`` (keys: languages or
    scripts)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    run = _rules(vocabularies, window, least_words, repeat_share, BANDS | (bands or {}))
    return src.mapInArrow(run, f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)
