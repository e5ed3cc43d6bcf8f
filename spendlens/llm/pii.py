"""Personal data with offset-preserving deobfuscation (operator 6).

Base kinds are found in the text as it is.  Then a chain of transducers
rewrites a copy of the text, and every character of the copy keeps the source
span that it stands for:

1. homoglyphs: full-width forms, other scripts' digits and look-alike letters
   become ASCII; invisible characters vanish;
2. disguises: ``[at]``, ``(dot)``, ``name at host dot org`` become ``@`` and ``.``;
3. spelled digits: ``plus one five five ...`` becomes ``+155...``.

Identifiers found in the copy are mapped back; one is added if its source
characters were rewritten and no base span of its kind holds it.  Offsets
count code points of the source, the end is exclusive.  Null texts are empty.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")

# An optional, possessive form of each base pattern: a run that does not match
# is passed over as a whole, which finds the same leftmost matches in linear time.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"([0-9]++)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Look-alikes of ASCII characters, in the order of their pairs.
_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "․": ".", "。": ".", "｡": ".", "﹒": ".",
    "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "﹢": "+",
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
_INVISIBLE = "­​‌‍⁠﻿"
#: First digit of each run of ten decimal digits that is read as 0 to 9.
_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
_FOLD = ({c: v for c, v in _LIKE.items()} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
         | {chr(z + d): str(d) for z in _ZEROS for d in range(10)})
_TABLE = str.maketrans(_FOLD | dict.fromkeys(_INVISIBLE))
_FOLDED = re.compile(f"[{re.escape(''.join(_FOLD) + _INVISIBLE)}]")

_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+)"
_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|ät)\s*[\])}>]\s*|\s+(?:at|arroba)\s+)"
_HOST = rf"[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*{_DOT}[A-Za-z0-9-]+"
#: ``at`` in brackets counts in front of any host; a bare ``at`` needs a disguised dot behind it.
_AT_SIGN = re.compile(rf"(?<=[A-Za-z0-9])(?:{_AT}(?={_HOST})|\s*[\[({{<]\s*(?:at|arroba|ät)\s*[\])}}>]\s*"
                      rf"(?=[A-Za-z0-9-]+(?:{_DOT}|\.)[A-Za-z0-9]))", re.IGNORECASE)
_DOT_SIGN = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.IGNORECASE)
_DISGUISE = re.compile(rb"[\[({<]\s*(?:at|arroba|dot|punkt|punto|point|\xc3\xa4t)\b|\s(?:dot|punkt|punto)\s", re.IGNORECASE)

# Digits in words.
_SPELLED = {
    "zero": "0", "oh": "0", "null": "0", "zéro": "0", "cero": "0",
    "one": "1", "eins": "1", "un": "1", "uno": "1",
    "two": "2", "zwei": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3",
    "four": "4", "vier": "4", "quatre": "4", "cuatro": "4",
    "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6",
    "seven": "7", "sieben": "7", "sept": "7", "siete": "7",
    "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
_ONE = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: At least four spelled digits in a row, with single digits among them.
_DIGITS = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_ONE})\b(?:(?:[\s,.-]{{1,3}}|\s+dot\s+)(?:(?:{_ONE})\b|[0-9]\b)){{3,}}", re.IGNORECASE)
_NUMBER = re.compile(rf"\b(?:{_ONE}|plus|dot)\b|[0-9]|(?<=\w)\.(?=\w)", re.IGNORECASE)


_SPELLED_BYTES = frozenset(w.encode() for w in _SPELLED)
_SINGLE = frozenset(b"%d" % d for d in range(10)) | {b"dot"}
#: Lower case, with the marks that may part spelled digits as blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 0x20 if chr(c) in ",.-" else c for c in range(256))
_DOTTED = (b"dot", b"punkt", b"punto", b"(", b"[", b"{", b"<")


def _has_spelled_run(raw: bytes) -> bool:
    """Whether four words in a row are digits, one of them spelled at least: a
    quick test that lets no run of ``_DIGITS`` pass by."""
    own = raw.translate(_PLAIN).lower().split()
    if _SPELLED_BYTES.isdisjoint(own):
        return False
    run = 0
    for w in own:
        w = w.strip(b"\"'()[]{}<>:;!?+*#$%&|/_")
        run = run + (w != b"dot") if w in _SPELLED_BYTES or w in _SINGLE else 0
        if run >= 4:
            return True
    return False


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed and then start."""
    spans = []
    if "@" in text:
        spans += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if m[2] and all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m.groups()):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


class Tape:
    """A rewritten text; character ``i`` stands for ``source[lo[i]:hi[i]]``."""

    def __init__(self, text: str):
        self.text, self.lo = text, np.arange(len(text))
        self.hi = self.lo + 1

    def fold(self) -> None:
        if _FOLDED.search(self.text):
            if gone := [m.start() for m in re.finditer(f"[{_INVISIBLE}]", self.text)]:
                self.lo, self.hi = np.delete(self.lo, gone), np.delete(self.hi, gone)
            self.text = self.text.translate(_TABLE)

    def rewrite(self, pattern: re.Pattern, new) -> None:
        """Replace every match by ``new(match)``, whose characters all stand
        for the whole match."""
        out, lo, hi, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            s = new(m)
            out += [self.text[at:a], s]
            lo += [self.lo[at:a], np.full(len(s), self.lo[a])]
            hi += [self.hi[at:a], np.full(len(s), self.hi[b - 1])]
            at = b
        if out:
            self.text = "".join(out) + self.text[at:]
            self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])

    def digits(self) -> None:
        """Spelled digits, each of which keeps its own word's span."""
        out, lo, hi, at = [], [], [], 0
        for m in _DIGITS.finditer(self.text):
            a, b = m.span()
            out.append(self.text[at:a])
            lo.append(self.lo[at:a])
            hi.append(self.hi[at:a])
            for x in _NUMBER.finditer(self.text, a, b):
                w = x[0].lower()
                out.append("+" if w == "plus" else "." if w == "dot" else _SPELLED.get(w, w))
                lo.append(self.lo[x.start():x.start() + 1])
                hi.append(self.hi[x.end() - 1:x.end()])
            at = b
        if out:
            self.text = "".join(out) + self.text[at:]
            self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])


def deobfuscated(text: str) -> Tape | None:
    """The rewritten text, or None if no transducer changes anything."""
    tape = Tape(text)
    if not text.isascii():
        tape.fold()
    raw = tape.text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(x in low for x in _DOTTED) and _DISGUISE.search(raw):
        tape.rewrite(_AT_SIGN, lambda m: "@")
        tape.rewrite(_DOT_SIGN, lambda m: ".")
    if _has_spelled_run(tape.text.encode("utf-8", "surrogatepass")):
        tape.digits()
    return None if tape.text == text else tape


def scan(text: str) -> tuple[list, list]:
    """Base spans and all spans, by kind as listed and then start."""
    base = find(text)
    tape = deobfuscated(text)
    if tape is None:
        return base, base
    more = []
    for kind, a, b in find(tape.text):
        lo, hi = int(tape.lo[a]), int(tape.hi[b - 1])
        if text[lo:hi] != tape.text[a:b]:
            more.append((kind, lo, hi))
    # Both lists are in order within a kind: one sweep finds what a base span holds already.
    added = []
    for k in KINDS:
        own, i = [s for s in base if s[0] == k], 0
        for s in (x for x in more if x[0] == k):
            while i < len(own) and own[i][2] < s[2]:
                i += 1
            if i == len(own) or own[i][1] > s[1]:
                added.append(s)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPANS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
                      + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(_SPANS)
def _scanned(text: pa.Array) -> pa.Array:
    rows = []
    for t in text:
        base, all_of = scan(t.as_py() or "")
        kinds = [k for k, _, _ in base]
        rows.append([*(kinds.count(k) for k in KINDS),
                     hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_of)])
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)], _SPANS.names)


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, a digest of the base spans, and all spans."""
    prepare(docs.sparkSession)
    return (docs.select(F.col(id_col), _scanned(F.col(text_col).cast("string")).alias("_s"))
            .select(id_col, "_s.*"))


def masked(text: str, mark: str = "[{}]") -> str:
    """``text`` with every span replaced by its kind; of spans that overlap,
    the first names the mark."""
    out, at = [], 0
    for kind, a, b in sorted(scan(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark.format(kind)]
        at = max(at, b)
    return "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def _masked(text: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else masked(t) for x in text], pa.string())


def mask_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text_col``; null stays null."""
    prepare(docs.sparkSession)
    return docs.select(*[_masked(F.col(c).cast("string")).alias(c) if c == text_col else F.col(c)
                         for c in docs.columns])
