"""Helpers shared by the operators: texts as Arrow batches, vectorised word
hashes, stored intermediate tables and small fixed-size bitmaps.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D`` (the same as runs of
code points, since all other code points use bytes above 0x7F or other ASCII).
A word or shingle is represented by a 64-bit hash of all its bytes; two
different ones of a table share a hash with a probability of about
``n * n / 2**65``.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at once; a longer text is cut at white space.
PIECE = 1 << 19
#: Bytes of rows that Spark puts in one Arrow batch (a single row may be larger).
BATCH_BYTES = 8 << 20

_U = np.uint64
_NOT_WS = np.ones(256, bool)
_NOT_WS[[0x20, *range(0x09, 0x0E)]] = False
_ODD = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); works on a copy."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _ODD)
_FOLD = np.arange(256)
_FOLD[ord("A"):ord("Z") + 1] += 32
_BYTE_FOLDED = _BYTE[_FOLD]


@dataclass
class Words:
    """Words of consecutive texts: hash, text number, first byte, end byte."""

    h: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def _piece(buf: np.ndarray, at: int, offs: np.ndarray, fold: bool):
    n = len(buf)
    word = _NOT_WS[buf]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offs[(offs > at) & (offs < at + n)] - at
    before[inner] = False
    start = np.flatnonzero(word & ~before)
    if not len(start):
        return np.empty(0, _U), start, start
    seen = np.cumsum(word)
    first = seen[start] - 1
    size = np.diff(np.append(first, seen[-1]))
    own = buf[word]
    x = (np.arange(len(own)) - np.repeat(first, size)).astype(_U)
    x *= _M2
    x += (_BYTE_FOLDED if fold else _BYTE)[own]
    x ^= x >> _U(32)
    x *= _M1
    x ^= x >> _U(29)
    h = mix(np.add.reduceat(x, first) + size.astype(_U) * _ODD)
    return h, start + at, start + at + size


def words(buf: np.ndarray, offs: np.ndarray, fold: bool = True) -> Words:
    """Words of the texts ``buf[offs[i]:offs[i + 1]]``; ``fold`` lower-cases
    A-Z.  Pieces of ``PIECE`` bytes bound the memory in use; a cut never
    falls inside a word."""
    parts, at, n = [], 0, len(buf)
    while at < n:
        to = min(n, at + PIECE)
        while to < n:
            gap = np.flatnonzero(~_NOT_WS[buf[max(at, to - PIECE):to]])
            if len(gap):
                to = max(at, to - PIECE) + int(gap[-1]) + 1
                break
            to = min(n, to + PIECE)
        parts.append(_piece(buf[at:to], at, offs, fold))
        at = to
    if not parts:
        parts = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))]
    h, start, end = (np.concatenate(p) for p in zip(*parts, strict=True))
    doc = np.searchsorted(offs, start, side="right") - 1
    return Words(h, doc, start, end, len(offs) - 1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    x = np.zeros(n, _U)
    for i in range(k):
        x *= _M2
        x += h[i:i + n]
        x ^= x >> _U(29)
    return mix(x * _ODD + _U(k))


def chunks(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column (null: empty) into runs of rows of about ``limit``
    bytes: ``(first row, end row, bytes, offsets)`` without copying texts."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset:]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """What every operator with Python code needs of a session.

    Arrow batches end by size, not by rows alone, so that many long texts
    never meet in one batch (a session's own lower setting stays); the package
    goes to the Python workers, wherever they run; and these use one thread for
    numpy's products, which are small (a task has one core; two threads cost
    twice the CPU time), unless ``spark.executorEnv.OMP_NUM_THREADS`` is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in spark.conf.get(key) if c.isdigit())
    if not digits or int(digits) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    sc.environment.setdefault("OMP_NUM_THREADS", "1")
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="spendlens-code-")) / "spendlens.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(at))


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session
    without that setting (tests) gets a scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spendlens-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spendlens-llm/{uuid.uuid4().hex}"


def stored(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    lineage and survives lost executors.  The files go when the session ends.
    A task holds a row group in memory when it writes and when it reads;
    ``row_group`` sets its bytes where rows are wide."""
    spark = df.sparkSession
    path = work_dir(spark)
    (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id's decimal text, modulo ``n`` (a null id: remainder null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


class Bitmap:
    """A set of 64-bit hashes in a bitmap of fixed size (``2**bits`` bits):
    it may hold a hash that was never added, but never loses one."""

    def __init__(self, words64: np.ndarray, bits: int):
        self.mask = _U((1 << bits) - 1)
        self.on = words64.view(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.on[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1

    def has_one(self, h: int) -> bool:
        """``has`` for one number (a negative one by its two's complement)."""
        at = h & int(self.mask)
        return bool(self.on[at >> 3] >> (at & 7) & 1)


def bitmap_of(df: DataFrame, col: str, bits: int = 20) -> Bitmap:
    """Bitmap of a long column, made on the executors: at most ``2**bits / 64``
    words of 64 bits reach the driver, whatever the size of ``df``."""
    word = F.shiftright(F.col(col).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    one = F.expr(f"shiftleft(1L, int({col} & 63L))")
    rows = df.groupBy(word.alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
    on = np.zeros(1 << bits - 6, np.int64)
    on[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return Bitmap(on, bits)


def _parted(docs: DataFrame, keys: DataFrame, on: dict) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Rows of ``docs`` that have no key in ``keys`` for sure, the others, the
    keys under other names, and the condition to join the two by (null matches
    null).  ``on`` maps the columns of ``keys`` to expressions over ``docs``.  A
    bitmap of fixed size lets most rows pass where they are."""
    names = {c: f"_key_{uuid.uuid4().hex}" for c in on}
    keys = stored(keys.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct())
    seen = bitmap_of(keys.select(F.xxhash64(*names.values()).alias("h")), "h", 24)

    @F.arrow_udf(T.BooleanType())
    def may_match(h: pa.Array) -> pa.Array:
        return pa.array(seen.has(h.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    maybe = may_match(F.xxhash64(*on.values()))
    same = F.lit(True)
    for c, n in names.items():
        same = same & on[c].eqNullSafe(F.col(n))
    return docs.where(~maybe), docs.where(maybe), keys, same


def without(docs: DataFrame, gone: DataFrame, on: dict) -> DataFrame:
    """Rows of ``docs`` without a match in ``gone`` (see ``_parted``); only those
    that may match are shuffled and joined."""
    sure, rest, gone, same = _parted(docs, gone, on)
    return sure.unionByName(rest.join(gone, same, "left_anti"))


def only_one(docs: DataFrame, repeated: DataFrame, on: dict) -> DataFrame:
    """``docs`` with one row alone for each key of ``repeated`` (see
    ``_parted``); a task sends on one row for each key it meets."""
    sure, rest, repeated, same = _parted(docs, repeated, on)
    rows = rest.join(repeated, same, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keys = list(repeated.columns)
    once = rest.join(repeated, same).select(row, *keys).groupBy(*keys).agg(F.first("row").alias("row"))
    return sure.unionByName(rows).unionByName(once.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
