"""N-gram Jaccard join (operator 1).

Documents are rows and n-grams are columns of a 0/1 incidence matrix ``M``; two
documents link when their overlap, an entry of ``M * M^T``, reaches
``threshold`` percent of the union.  The product is taken in blocks:

1. *Classes.*  Rows with equal n-gram sets are one class; only classes join.
   The row of the smallest id stands for a class that has several (``Firsts``).
2. *Columns.*  Columns are ordered by (common, hash).  With ``n`` n-grams a
   class has to be looked at in its first ``n - ceil(t * n) + 1`` columns
   alone: classes that share none of these are under the bound derived from
   their sizes.  "Common" is any fixed set of columns; it holds those met in
   more than ``common_df`` rows (counted over all rows by ``LEAD`` bits of the
   hash, packed by hash range before the shuffle), as a bitmap of fixed size,
   so a passage that many documents share comes last and is rarely looked at.
3. *Sure links.*  Each class is compared with one pivot, which it meets in most
   column blocks (a star, not all pairs); connected classes get one label.  Common columns are salted, so a hot one is spread over many tasks.
4. *Product of common columns.*  Classes that common columns connect form a
   cell.  A cell is cut into blocks of about ``MEMBERS`` classes, and for each
   pair of blocks one task multiplies the incidence matrices and gives back a
   spanning set of the links between different labels; blocks of one label are
   not multiplied.  So a group of n near copies makes n * blocks rows, not
   n * n pairs.
5. *Product of the other columns.*  Each holds few classes.  Overlap counts of
   pairs of different labels are accumulated, a pair is discarded when its
   count plus what can still follow is under the bound, and the pairs that are
   left are compared by their whole sets.

Pairs inside a label are already connected, so no link between components is
lost.

Nulls and texts without words give ``n_shingles`` 0 and link with nothing;
fewer words than ``width`` give one n-gram; repeated rows share a class;
a null id is returned with its class's component (or null).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import (Bitmap, bitmap_of, prepare, chunks, mix, stored,
                                  only_one, windows, without, words)
from spendlens.llm.components import connected_components

_U = np.uint64
#: Classes a task remembers to leave out copies it has already emitted.
SEEN = 200_000


def _sets(col: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of every text."""
    for first, _, buf, offs in chunks(col):
        w = words(buf, offs)
        grams = windows(w.h, width)
        b = w.bounds()
        for i in range(w.n_docs):
            n = b[i + 1] - b[i]
            if n == 0:
                yield first + i, np.empty(0, _U)
            elif n < width:
                yield first + i, windows(w.h[b[i]:b[i + 1]], n)
            else:
                s = np.sort(grams[b[i]:b[i + 1] - width + 1])
                yield first + i, s[np.append(True, s[1:] != s[:-1])]


def _class(s: np.ndarray) -> int:
    """Key of a set: a 64-bit hash of its size and two sums over members."""
    x = np.array([mix(s).sum(), mix(s ^ _U(0x5851F42D4C957F2D)).sum(), len(s)], _U)
    return int(windows(x, 3).view(np.int64)[0])


def _need(n: int, t: int) -> int:
    """Smallest overlap of a set of ``n`` with a partner: ceil(t * n / 100)."""
    return -(-t * n // 100)


def _ordered(s: np.ndarray, common: Bitmap | None, k: int) -> tuple[np.ndarray, int]:
    """First ``k`` columns of a set, and how many of them are not common."""
    if common is None:
        return s[:k], min(k, len(s))
    on = common.has(s >> _U(64 - LEAD))
    rare = s[~on][:k]
    return np.concatenate([rare, s[on][:k - len(rare)]]), len(rare)


#: Leading bits of a column's hash by which rows are counted for the column order.
LEAD = 40
#: Characters of text a range of columns at most.
RANGE = 32 << 20
#: Columns that a task holds before it deals them out.
HELD = 2_000_000


def _pack(x: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences."""
    d = np.diff(x, prepend=_U(0))
    planes = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :data[0]] = planes.T
    return np.cumsum(d.view(_U).ravel())


_ROW = "id struct<id:long,h:long>"
_SKETCH = f"part int, {_ROW}, n long, cls long, cols binary"


def _sketch(width: int, parts: int):
    """One row for each document, and the columns of each class as packed
    lists, one for each of ``parts`` hash ranges."""
    span = (1 << LEAD) // parts + 1

    def packed(held):
        x = np.sort(np.concatenate(held) >> _U(64 - LEAD))
        cut = np.searchsorted(x, np.arange(parts + 1, dtype=_U) * _U(span))
        some = [i for i in range(parts) if cut[i] < cut[i + 1]]
        return _rows(some, [None] * len(some), [None] * len(some), [None] * len(some),
                     [_pack(x[cut[i]:cut[i + 1]] - _U(i * span)) for i in some])

    def run(batches):
        held, n_held, seen, dealt = [], 0, set(), 0
        for b in batches:
            n, cls = [], []
            for _, s in _sets(b.column(1), width):
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                if len(s) and cls[-1] not in seen:
                    if len(seen) < SEEN:
                        seen.add(cls[-1])
                    held.append(s)
                    n_held += len(s)
                    if n_held > HELD:
                        yield packed(held)
                        held, n_held = [], 0
            # Rows of documents are only passed on: dealt in turn, so copies do not meet.
            yield _rows([(dealt + i) % parts for i in range(len(n))], b.column(0).cast(_ID), n, cls, [None] * len(n))
            dealt += len(n)
        if held:
            yield packed(held)
    return run


_ID = pa.struct([("id", pa.int64()), ("h", pa.int64())])


def _rows(part, ids, n, cls, cols) -> pa.RecordBatch:
    return _batch(part=pa.array(part, pa.int32()), id=ids if isinstance(ids, pa.Array) else pa.array(ids, _ID),
                  n=pa.array(n, pa.int64()), cls=pa.array(cls, pa.int64()), cols=pa.array(cols, pa.binary()))


def _often(parts: int, common_df: int):
    """Passes documents on; of the packed columns of a range, gives those in
    more than ``common_df`` lists.  Rows come sorted by range."""
    span = (1 << LEAD) // parts + 1

    def common(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        x = x[first[np.diff(np.append(first, len(x))) > common_df]].view(np.int64) + part * span
        none = pa.nulls(len(x), pa.int64())
        return _batch(id=pa.nulls(len(x), _ID), n=none, cls=none, col=pa.array(x))

    def run(batches):
        now, held = None, []
        for b in batches:
            doc = b.filter(pc.is_null(b.column("cols")))
            yield _batch(id=doc.column("id").cast(_ID), n=doc.column("n"), cls=doc.column("cls"),
                         col=pa.nulls(doc.num_rows, pa.int64()))
            packed = b.filter(pc.is_valid(b.column("cols")))
            for part, data in zip(packed.column("part").to_pylist(), packed.column("cols").to_pylist(), strict=True):
                if part != now and held:
                    yield common(now, held)
                    held = []
                now = part
                held.append(_unpack(data))
        if held:
            yield common(now, held)
    return run


@dataclass
class Firsts:
    """Which rows stand for their classes.  Of a class of one row it is that
    row.  A class in the bitmap ``repeated`` has the row of its smallest id
    (rows without one, if it has no other) in ``first``, also where the bitmap
    holds it by chance, so every class keeps a row; bitmaps of fixed size may
    keep more rows, never fewer."""

    repeated: Bitmap
    first: Bitmap

    def stands(self, cls: int, key: int) -> bool:
        return not self.repeated.has_one(cls) or self.first.has_one(cls ^ key)


def _firsts(classes: DataFrame) -> Firsts:
    """From ``(cls, low, copies)``; ``key`` of a row is the hash of its id."""
    repeated = bitmap_of(classes.where("copies > 1"), "cls", 24)

    @F.arrow_udf(T.BooleanType())
    def held(c: pa.Array) -> pa.Array:
        return pa.array(repeated.has(c.to_numpy(zero_copy_only=False).view(_U)), pa.bool_())

    key = F.col("cls").bitwiseXOR(F.xxhash64("low"))
    return Firsts(repeated, bitmap_of(classes.where(held("cls")).select(key.alias("key")), "key", 24))


def _incidence(width: int, t: int, common: Bitmap, salts: int, firsts: Firsts):
    """Entries of the matrix that have to be looked at: block, class, the
    class's size and the entry's rank in one number, and the column where it is
    common.  A common column has ``salts`` blocks, any other is a block."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            rows, held, key = [], 0, b.column(1).to_pylist()
            for i, s in _sets(b.column(0), width):
                if not len(s) or (c := _class(s)) in seen or not firsts.stands(c, key[i]):
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                p, rare = _ordered(s, common, len(s) - _need(len(s), t) + 1)
                block = p.copy()
                block[rare:] = mix(p[rare:] + _U((c % salts + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                rows.append((block, np.full(len(p), c, np.int64), (len(s) << 31) + np.arange(len(p)), p, np.arange(len(p)) < rare))
                held += len(p)
                if held > 200_000:
                    yield _entries(rows)
                    rows, held = [], 0
            if rows:
                yield _entries(rows)
    return run


def _entries(rows) -> pa.RecordBatch:
    block, cls, at, col, rare = (np.concatenate(x) for x in zip(*rows, strict=True))
    return _batch(block=block.view(np.int64), cls=cls, at=at, col=pa.array(col.view(np.int64), mask=rare))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], list(cols))


def _wanted(width: int, keep: list[Bitmap], firsts: Firsts | None = None):
    """Whole sets of the classes in a bitmap of ``keep`` (and of a few others),
    with the bitmaps' numbers as bits of ``use``; with ``firsts``, from the rows
    that stand for their classes."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            cls, sets, use, held = [], [], [], 0
            key = b.column(1).to_pylist() if firsts else None
            for i, s in _sets(b.column(0), width):
                if not len(s) or (c := _class(s)) in seen or firsts and not firsts.stands(c, key[i]):
                    continue
                if not (u := sum(1 << j for j, k in enumerate(keep) if k.has_one(c))):
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                cls.append(c)
                sets.append(s.view(np.int64))
                use.append(u)
                held += len(s)
                if held > 200_000:
                    yield _batch(cls=pa.array(cls, pa.int64()), s=pa.array(sets, pa.list_(pa.int64())), use=pa.array(use, pa.int32()))
                    cls, sets, use, held = [], [], [], 0
            if cls:
                yield _batch(cls=pa.array(cls, pa.int64()), s=pa.array(sets, pa.list_(pa.int64())), use=pa.array(use, pa.int32()))
    return run


#: Members that are compared with one copy of their pivot's set, and classes of a block.
MEMBERS = 512


def _whole_sets(text: DataFrame, width: int, firsts: Firsts, *classes: DataFrame) -> DataFrame:
    """``(cls, s, use)``: the sets of the classes in a column ``cls`` (and of a
    few others), made anew from the texts; a class may come several times."""
    return text.mapInArrow(_wanted(width, [bitmap_of(c, "cls", 23) for c in classes], firsts), "cls long, s array<long>, use int")


def _verified(sets: DataFrame, roles: DataFrame, t: int) -> DataFrame:
    """The pairs (member, pivot) whose whole sets reach the threshold."""
    group = Window.partitionBy("key", "part").orderBy("role").rowsBetween(Window.unboundedPreceding, 0)
    both = F.size(F.array_intersect("s", "pivot"))
    union = F.size("s") + F.size("pivot") - both
    return (sets.select("cls", "s").join(roles, "cls").withColumn("pivot", F.first("s").over(group))
            .where((F.col("role") == 1) & (100 * both >= t * union))
            .select(F.col("cls").alias("a"), F.col("key").alias("b")).distinct())


def _roles(pairs: DataFrame) -> DataFrame:
    """Members ``a`` and pivots ``b`` by groups: a pivot's set is dealt to one
    group for every ``MEMBERS`` members, so no group is large."""
    many = pairs.groupBy("b").count().withColumn("parts", F.ceil(F.col("count") / MEMBERS))
    members = (pairs.join(many, "b")
               .select(F.col("a").alias("cls"), F.col("b").alias("key"),
                       F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(1).alias("role")))
    pivots = many.select(F.col("b").alias("cls"), F.col("b").alias("key"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                         F.lit(0).alias("role"))
    return members.unionByName(pivots)


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that connect something not yet connected."""
    root: dict[int, int] = {}

    def top(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


#: Columns that are multiplied at once.
COLUMNS = 4096


def _product(t: int):
    """Links between different labels of two blocks of classes, or within one."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        left, right = (x.drop_duplicates("cls") for x in (left, right if len(right) else left))
        ids = [np.unique(np.concatenate(list(x.s))) for x in (left, right)]
        both = np.intersect1d(*ids, assume_unique=True)
        counts = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(both), COLUMNS):
            cols = both[lo:lo + COLUMNS]
            m = []
            for x in (left, right):
                dense = np.zeros((len(x), len(cols)), np.float32)
                for i, s in enumerate(x.s):
                    at = np.searchsorted(cols, s)
                    at = at[cols[np.minimum(at, len(cols) - 1)] == s]
                    dense[i, at] = 1
                m.append(dense)
            counts += m[0] @ m[1].T
        size = [np.array([len(s) for s in x.s], np.float64) for x in (left, right)]
        hit = ((100 * counts >= t * (size[0][:, None] + size[1][None, :] - counts))
               & (left.label.to_numpy()[:, None] != right.label.to_numpy()[None, :]))
        i, j = np.nonzero(hit)
        links = _spanning(left.cls.to_numpy()[i], right.cls.to_numpy()[j])
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def _blocks(dense: DataFrame, label: DataFrame) -> DataFrame:
    """Classes that meet in common columns, dealt to pairs of blocks:
    ``(pair, side, cls, label)``.  Within a cell (what is connected by common
    columns) a large component makes blocks of its own, which are never
    compared with each other; the others are mixed by hash."""
    at = (dense.join(label.withColumnRenamed("node", "cls"), "cls", "left")
          .withColumn("label", F.coalesce("label", "cls")))
    size = at.groupBy("cell", "label").agg(F.count("*").alias("size"))
    several = size.groupBy("cell").count().where("count > 1").select("cell")
    size = size.join(several, "cell", "left_semi").withColumn(
        "own", F.when(F.col("size") >= MEMBERS, F.col("label")))
    parts = size.groupBy("cell", "own").agg(F.ceil(F.sum("size") / MEMBERS).alias("parts"))
    dealt = (size.alias("s").join(parts.alias("p"), F.expr("s.cell = p.cell and s.own <=> p.own"))
             .select("s.cell", "s.label", "s.own", "p.parts"))
    at = stored(at.join(dealt, ["cell", "label"])
                .withColumn("block", F.xxhash64("own", F.pmod(F.xxhash64("cls"), "parts"))))
    names = at.select("cell", "block", "own").distinct()
    x = names.select("cell", F.col("block").alias("x"), F.col("own").alias("xo"))
    y = names.select("cell", F.col("block").alias("y"), F.col("own").alias("yo"))
    pairs = x.join(y, "cell").where("x <= y and not (xo is not null and xo <=> yo)")
    sides = pairs.withColumn("pair", F.xxhash64("cell", "x", "y"))
    sides = (sides.select("cell", "pair", F.col("x").alias("block"), F.lit(0).alias("side"))
             .unionByName(sides.where("x <> y").select("cell", "pair", F.col("y").alias("block"), F.lit(1).alias("side"))))
    return at.select("cell", "block", "cls", "label").join(sides, ["cell", "block"]).select("pair", "side", "cls", "label")


def _sizes_fit(x: str, y: str, t: int):
    """The smaller of two sets has at least t percent of the larger's size."""
    return (F.col(x) * 100 >= F.col(y) * t) & (F.col(y) * 100 >= F.col(x) * t)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``; see
    ``_components`` for the parameters and the module text for the method."""
    return _components(docs, id_col, text_col, **params).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: int = 80,
                common_df: int = 8, salts: int = 32) -> DataFrame:
    """``(id, h, n, cls, grp, component_id)`` of every row: a hash of its text,
    the size and the class of its set, and a number of its component (an id may
    be the smallest of several); the threshold is in percent."""
    spark, t = docs.sparkSession, threshold
    prepare(spark)
    own = F.col(text_col).cast("string")
    src = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(own).alias("h")).alias("id"), own.alias("text"))
    text = src.select("text", F.xxhash64("id.id").alias("key"))
    # Hash ranges of a size that a task can count, however large the table.
    chars = src.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE))
    sketch = (src.mapInArrow(_sketch(width, parts), _SKETCH).repartition("part").sortWithinPartitions("part")
              .mapInArrow(_often(parts, common_df), f"{_ROW}, n long, cls long, col long"))
    sketch = stored(sketch)
    sig = sketch.where("n is not null").select("id.id", "id.h", "n", "cls")
    common = bitmap_of(sketch.where("col is not null"), "col", 24)
    classes = stored(sig.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    firsts = _firsts(classes)

    # The pivot of a block is the class that has the column at its lowest rank:
    # of a text and its variants that is the text itself, since words that a
    # variant alone has come before the common ones.  Salted blocks of a hot
    # column meet through their pivots.
    entries = text.mapInArrow(_incidence(width, t, common, salts, firsts), "block long, cls long, at long, col long").repartition("block")
    rank, size = F.col("at").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright("at", 31)
    block, column = Window.partitionBy("block"), Window.partitionBy("col")
    shared = (entries.withColumn("lo", F.min(F.struct(rank.alias("rank"), "cls", size.alias("n"))).over(block))
              .withColumn("x", F.min("cls").over(block)).withColumn("y", F.max("cls").over(block))
              .where("x <> y or col is not null")
              .select("block", "col", "cls", rank.alias("rank"), size.alias("n"), F.col("lo.rank").alias("r"),
                      F.col("lo.cls").alias("pivot"), F.col("lo.n").alias("m")))
    shared = stored(shared)
    ends = shared.where("col is not null").select("col", F.struct("r", "pivot", "m").alias("e")).distinct()
    met = ends.withColumn("lo", F.min("e").over(column)).select(
        F.col("e.pivot").alias("cls"), F.col("e.m").alias("n"), F.col("lo.pivot").alias("pivot"), F.col("lo.m").alias("m"))
    near = shared.select("cls", "n", "pivot", "m").unionByName(met)
    stars = (near.where((F.col("cls") != F.col("pivot")) & _sizes_fit("n", "m", t))
             .groupBy(F.col("cls").alias("a"), F.col("pivot").alias("b"), "n").agg(F.count("*").alias("c"))
             .where(F.col("c") * 20 >= F.col("n"))
             .groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b"))
    roles = stored(_roles(stored(stars)))
    sure = stored(_verified(_whole_sets(text, width, firsts, roles), roles, t))
    label = connected_components(sure)

    # Common columns: connected classes make a cell, cells are multiplied by blocks.
    dense = shared.where("col is not null")
    edges = (dense.select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
             .unionByName(met.select(F.col("cls").alias("a"), F.col("pivot").alias("b"))))
    cell = connected_components(edges).select(F.col("node").alias("cls"), F.col("label").alias("cell"))
    dealt = stored(_blocks(cell, label))

    # Other columns hold few classes each: their pairs are counted one by one.
    marked = (shared.where("col is null").select("block", "cls", "n", "rank").distinct()
              .join(label.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("label", F.coalesce("label", "cls")))
    x = marked.select("block", *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "rank", "label")])
    y = marked.select("block", *[F.col(c).alias(f"y_{c}") for c in ("cls", "n", "rank", "label")])
    least = F.ceil((F.col("x_n") + F.col("y_n")) * t / F.lit(100.0 + t) - 1e-6)
    rest = F.least(F.col("x_n") - F.col("x_rank"), F.col("y_n") - F.col("y_rank")) - 1
    met_before = F.least(F.col("x_rank"), F.col("y_rank"))
    product = (x.join(y, "block").where((F.col("x_cls") < F.col("y_cls")) & (F.col("x_label") != F.col("y_label"))
                                      & _sizes_fit("x_n", "y_n", t) & (met_before + 1 + rest >= least))
               .select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"), least.alias("least"),
                       F.struct("x_rank", rest.alias("rest")).alias("at")))
    pairs = (product.groupBy("a", "b", "least").agg(F.count("*").alias("c"), F.max("at").alias("last"))
             .where(F.col("c") + F.col("last.rest") >= F.col("least")).select("a", "b"))
    roles = stored(_roles(stored(pairs)))

    sets = stored(_whole_sets(text, width, firsts, roles, dealt))
    found = (dealt.join(sets.where("use >= 2").select("cls", "s"), "cls").groupBy("pair")
             .applyInPandas(_product(t), "a long, b long"))
    label = connected_components(sure.unionByName(_verified(sets.where("use % 2 = 1"), roles, t)).unionByName(found))

    # From classes to documents: the smallest id of each component.
    lab = classes.drop("copies").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    lows = (lab.where("label is not null").groupBy("label").agg(F.min("low").alias("root")))
    owner = (lab.join(lows, "label", "left")
             .select("cls", F.coalesce("label", "cls").alias("grp"), F.coalesce("root", "low").alias("component_id")))
    out = sig.where("n > 0").join(owner, "cls").select("id", "h", "n", "cls", "grp", "component_id")
    return out.unionByName(sig.where("n = 0").select("id", "h", "n", "cls", F.col("cls").alias("grp"), F.col("id").alias("component_id")))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest id, and of
    several texts under that id the one of the smallest hash.  Rows equal in id
    and text are one document, and one of them stays.  A row with a null id
    stays where no row with an id stands for it, one for each set of n-grams;
    rows without words link with nothing."""
    comp = stored(_components(docs, id_col, text_col, **params))
    # One row for each (id, text); which of them stays is settled by key alone.
    one = comp.groupBy("id", "h", "cls", "grp", "component_id").agg(F.count("*").alias("copies"))
    same = F.when(F.col("component_id").isNull(), F.col("cls")).otherwise(F.col("grp"))  # without any id: by class
    low = one.where("cls is not null and id <=> component_id").groupBy(same.alias("c")).agg(F.min("h").alias("low"))
    at = one.withColumn("c", same).join(low, "c", "left")
    gone = F.col("cls").isNotNull() & ~(F.col("id").eqNullSafe(F.col("component_id")) & F.col("h").eqNullSafe(F.col("low")))
    at = stored(at.select("id", "h", "copies", gone.alias("gone")))
    keys = {"id": F.col(id_col).cast("long"), "h": F.xxhash64(F.col(text_col).cast("string"))}
    return only_one(without(docs, at.where("gone").select("id", "h"), keys), at.where("copies > 1 and not gone").select("id", "h"), keys)
