r"""Secret scans with structural confirmation (operator 2).

Base kinds are patterns alone (assignments, access keys, hex runs).  Beyond
them, runs of base64 or hex characters are candidates that count only if what
they decode to has the structure of a secret:

* ``pem``: a BEGIN/END block whose body is base64 of a DER key or of an OpenSSH
  key, or of an encrypted DER key;
* ``der``: base64 or hex of an ASN.1 SEQUENCE whose nested lengths add up
  exactly and which starts like a PKCS#1, PKCS#8 or SEC1 key;
* ``ssh``: base64 of an ``openssh-key-v1`` container or of a public key blob
  whose length-prefixed fields fill it exactly;
* ``jwt``: three parts, the first of which is a JSON object with ``alg``, the
  second a JSON object.

A key may begin behind a ``/``, ``-`` or ``_`` of its run and may be wrapped into
lines of one length; a line end may be the two characters ``\n``.

A text is scanned whole; cheap byte searches decide whether a pattern is run
at all.  Offsets count code points, the end is exclusive.  Null texts are
empty and have no spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import prepare

#: Kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Lines of one run; a line ends by a line end or by the two characters ``\\n``.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?:(?:\\r)?(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_HEX_ONLY = re.compile("[0-9a-fA-F]++")
_LINE = re.compile(r"(?:^|(?<=\n)|(?<=\\n))[ \t]*([A-Za-z0-9+/_-]+={0,2})")
#: Where a key can begin inside a run, and a token's header inside its part.
_BEHIND = re.compile(r"[/_-](?=M[A-P]|AAAA|b3BlbnNz|30)")
_HEADER = re.compile(r"ey[JA]|ew[o0k]")
_HEADERS = (b"eyJ", b"eyA", b"ewo", b"ew0", b"ewk")
_PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+={0,2}))")
_ODD = re.compile("[\udc80-\udcff]")
_JSON = json.JSONDecoder()
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
#: Every ASCII character that is no letter or digit of a run becomes a blank.
_SHAPE = bytes(0x61 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 0x20 for c in range(256))
_HEX_SHAPE = bytes(0x61 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))

#: What follows the outer SEQUENCE of a key: INTEGER 0 or 1 and
#: then an INTEGER (PKCS#1), a SEQUENCE (PKCS#8) or an OCTET STRING (SEC1); or a
#: SEQUENCE with an OID (public key, encrypted PKCS#8).
_INTEGER, _OCTETS, _BITS, _OID, _SEQUENCE = 0x02, 0x04, 0x03, 0x06, 0x30


def der_fields(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(tag, first byte, end byte)`` of the values that fill ``data[start:end]``
    exactly in definite-length DER, or None."""
    end = len(data) if end is None else end
    fields = []
    while start < end:
        if start + 2 > end or data[start] & 0x1F == 0x1F:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at:at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        fields.append((tag, at, at + n))
        start = at + n
    return fields


def is_der_key(data: bytes, start: int = 0) -> bool:
    """Whether ``data[start:]`` is a key; anything but a SEQUENCE that ends
    where the data ends is turned down at its first bytes."""
    if start + 2 > len(data) or data[start] != _SEQUENCE:
        return False
    n, at = data[start + 1], start + 2
    if n & 0x80:
        n, at = int.from_bytes(data[at:at + (n & 0x7F)], "big"), at + (n & 0x7F)
    outer = der_fields(data, start) if at + n == len(data) else None
    if not outer or len(outer) != 1:
        return False
    inner = der_fields(data, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [f[0] for f in inner]
    if tags[0] == _INTEGER:
        if tags[1] == _INTEGER:  # RSA: version and eight numbers, or a modulus and exponent
            return len(tags) in (2, 6, 9, 10) and set(tags[:6]) == {_INTEGER}
        if tags[1] == _SEQUENCE:
            algorithm = der_fields(data, *inner[1][1:])
            return bool(algorithm) and algorithm[0][0] == _OID and len(tags) > 2 and tags[2] == _OCTETS
        return tags[1] == _OCTETS
    if tags[0] == _SEQUENCE:
        algorithm = der_fields(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == _OID and tags[1] in (_BITS, _OCTETS)
    return False


def is_ssh_key(data: bytes, start: int = 0) -> bool:
    """Whether ``data[start:]`` is a key container or a public key blob."""
    def fields(at: int, count: int) -> int | None:
        """End of ``count`` length-prefixed fields (all that follow if -1)."""
        while count and at < len(data):
            n = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + n > len(data):
                return None
            at, count = at + 4 + n, count - 1
        return None if count > 0 else at

    if data.startswith(magic := b"openssh-key-v1\0", start):
        at = fields(start + len(magic), 3)  # cipher, kdf, kdf options
        if at is None or at + 4 > len(data):
            return False
        keys = int.from_bytes(data[at:at + 4], "big")
        return 1 <= keys <= 16 and fields(at + 4, keys + 1) == len(data)
    n = int.from_bytes(data[start:start + 4], "big")
    return (4 <= n <= 40 and data.startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"), start + 4)
            and fields(start, -1) == len(data) and len(data) > start + 4 + n)


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_jwt(text: str) -> bool:
    parts = text.split(".")
    if len(parts) != 3:
        return False
    for k, part in enumerate(parts[:2]):
        data = _b64(part)
        try:
            value = json.loads(data) if data else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or k == 0 and not isinstance(value.get("alg"), str):
            return False
    return True


class Decoded:
    """The bytes of a run's tails: those that begin at one position modulo 4
    share one decoding."""

    def __init__(self, run: str):
        self.run, self.kept = run, {}

    def tail(self, at: int) -> tuple[bytes | None, int]:
        """The bytes that hold ``run[at:]``, and where it begins in them."""
        k = at % 4
        if k not in self.kept:
            self.kept[k] = _b64(self.run[k:])
        return self.kept[k], (at - k) // 4 * 3


def confirm(run: str, at: int = 0, decoded: Decoded | None = None) -> str | None:
    """The kind of key or token that ``run[at:]`` decodes to."""
    if not at and run.count(".") == 2:
        return "jwt" if is_jwt(run) else None
    forms = [(decoded or Decoded(run)).tail(at)]
    if (len(run) - at) % 2 == 0 and _HEX_ONLY.fullmatch(run, at):
        forms.append((bytes.fromhex(run[at:]), 0))
    for data, start in forms:
        if data and is_der_key(data, start):
            return "der"
        if data and is_ssh_key(data, start):
            return "ssh"
    return None


def base_spans(text: str, shape: bytes | None = None) -> list[tuple[str, int, int]]:
    spans = []
    raw = shape if shape is not None else text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(k.encode() in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"a" * 32 in raw.translate(_HEX_SHAPE):
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def confirmed_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    raw = raw if raw is not None else text.encode("utf-8", "surrogatepass")
    spans, end = [], 0
    begins = list(_BEGIN.finditer(text)) if b"-----BEGIN " in raw else []
    after_each = [*(x.start() for x in begins), len(text)][1:]
    for m, after in zip(begins, after_each, strict=False):
        end = end if end >= m.end() else text.find("-----END ", m.end())
        if end < 0:
            break
        if end > after:  # another block begins first
            continue
        tail = f"-----END {m[1]}-----"
        body = re.sub(r"\\+n", "\n", re.sub(r"\\+r|\r", "", text[m.end():end]))
        data = _b64("".join(body.split("\n\n")[-1].split()))
        if text.startswith(tail, end) and data and (is_der_key(data) or is_ssh_key(data)):
            spans.append(("pem", m.start(), end + len(tail)))
    if any(h in raw for h in _HEADERS):
        spans += token_spans(text)
    if b"a" * 24 in raw.translate(_SHAPE):
        spans += wrapped_spans(text, spans)
        blocks, k = sorted(spans, key=lambda x: x[1]), 0
        for m in _RUN.finditer(text):
            while k < len(blocks) and blocks[k][2] <= m.start():
                k += 1
            inside = k < len(blocks) and blocks[k][1] < m.end()  # a line of a block's body
            if not inside:
                decoded = Decoded(m[0])
                for at in (0, *(x.end() for x in _BEHIND.finditer(m[0]))):
                    if len(m[0]) - at >= 24 and (kind := confirm(m[0], at, decoded)):
                        spans.append((kind, m.start() + at, m.end()))
                        break
    return spans


def header_at(part: str) -> int | None:
    """Where in a token's first part a JSON object with ``alg`` begins that ends
    with the part; each position modulo 4 is decoded once."""
    decoded, texts = Decoded(part), {}
    for h in _HEADER.finditer(part):
        data, at = decoded.tail(h.start())
        if data is None:
            continue
        if (k := h.start() % 4) not in texts:
            whole = data.decode("utf-8", "surrogateescape")
            odd = [x.end() for x in _ODD.finditer(whole)]
            # Bytes up to the last invalid one, the text behind them, and where its characters begin.
            lead = len(whole[:odd[-1]].encode("utf-8", "surrogateescape")) if odd else 0
            chars = np.cumsum((np.frombuffer(data, np.uint8)[lead:] & 0xC0) != 0x80)
            texts[k] = lead, whole[odd[-1]:] if odd else whole, chars
        lead, text, chars = texts[k]
        if at < lead:
            continue
        try:
            value, end = _JSON.raw_decode(text, int(chars[at - lead]) - 1)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) and isinstance(value.get("alg"), str) and not text[end:].strip(" \t\r\n"):
            return h.start()
    return None


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens; a header may begin anywhere in its part."""
    spans, end = [], 0
    for m in _PARTS.finditer(text):
        if m.start() < end or not _HEADER.search(m[0]) or not is_jwt("eyJhbGciOiIifQ" + m[1]):  # is its payload one?
            continue
        if (at := header_at(m[0])) is not None:
            end = m.end(1)
            spans.append(("jwt", m.start() + at, end))
    return spans


def wrapped_spans(text: str, taken) -> list[tuple[str, int, int]]:
    """Keys in lines of one length and a last one that may be shorter."""
    spans, taken, k = [], sorted(taken, key=lambda x: x[2]), 0
    for m in _LINES.finditer(text):
        while k < len(taken) and taken[k][2] <= m.start():
            k += 1
        if k < len(taken) and min(a for _, a, _ in taken[k:k + 2]) < m.end():
            continue
        lines = [x.span(1) for x in _LINE.finditer(m[0])]
        i = 0
        while i < len(lines):
            j, size = i + 1, lines[i][1] - lines[i][0]
            while j < len(lines) and lines[j][1] - lines[j][0] == size:
                j += 1
            ends = [j + 1] if j < len(lines) and lines[j][1] - lines[j][0] < size else []
            for to in [*ends, j]:
                if to - i > 1 and (kind := confirm("".join(m[0][a:b] for a, b in lines[i:to]))):
                    spans.append((kind, m.start() + lines[i][0], m.start() + lines[to - 1][1]))
                    j = to
                    break
            i = j
    return spans


def _by_start(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str) -> tuple[list, list]:
    """Base spans and all spans of a text, by start and then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    base = _by_start(base_spans(text, raw))
    return base, _by_start(base + confirmed_spans(text, raw))


_SPANS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE]
                      + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(_SPANS)
def _scanned(text: pa.Array) -> pa.Array:
    cols: list[list] = [[], [], [], [], []]
    for t in text:
        base, all_of = scan(t.as_py() or "")
        kinds = [k for k, _, _ in base]
        for col, v in zip(cols, [*(kinds.count(k) for k in BASE),
                                 hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_of)], strict=True):
            col.append(v)
    long, string = pa.int64(), pa.string()
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, [long] * 3 + [string] * 2, strict=True)],
                                      _SPANS.names)


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, a digest of the base spans, and all spans."""
    prepare(docs.sparkSession)
    return (docs.select(F.col(id_col), _scanned(F.col(text_col).cast("string")).alias("_s"))
            .select(id_col, "_s.*"))


def redact(text: str, mark: str = "[SECRET:{}]") -> str:
    """``text`` with every span replaced; spans that overlap become one, named
    after the first."""
    out, at, last = [], 0, 0
    for kind, a, b in scan(text)[1]:
        if a >= last:
            out += [text[at:a], mark.format(kind)]
        at = last = max(last, b)
    return "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else redact(t) for x in text], pa.string())


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by a mark; ``length_col``, if there is
    one, follows the new text where the text has changed.  Null stays null.
    The row travels as one struct, so no column's name can clash."""
    prepare(docs.sparkSession)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    row = row.withColumn("new", _redacted(F.col("row")[text_col].cast("string")))
    cols = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == text_col:
            own = F.col("new")
        elif c == length_col:
            own = F.when(F.col("new") != F.col("row")[text_col], F.length("new")).otherwise(own).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return row.select(*cols)
