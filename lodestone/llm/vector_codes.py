"""Product-quantisation codes of vectors by filtering Lloyd rounds.

Vectors are cut into equal parts, and each part position has a codebook of integer entries. Every map task builds
kd-trees over the parts of its blocks of vectors, with the boxes, counts and sums of all nodes; the trees are written
once to the shared folder and read in each round. A round walks the trees level by level: of the entries that a node
may still belong to, the one nearest to the box's centre eliminates those that are farther than it at every point of
the box, and a node with one entry left is assigned as a whole, by its cached count and sum. Leaves that stay open
compare their points with the entries left. What a round sends to the driver is the counts and sums of the entries,
which are as many as the codebooks hold, whatever the number of vectors.

All arithmetic is exact: float64 below 2^53, int64 below 2^62, Python integers above, chosen for each block.

Edge cases: rows whose vector is null, holds null, NaN or an infinity, is empty or can't be cut into equal parts, has
not as many components as the vector of the smallest id, or has a component of 2^50 or more (its errors fit no long)
are left out. Rows that repeat an id are rows of their own; codebooks start from rows ordered by id and vector, rows
without an id last. With fewer rows than entries a codebook has fewer. An empty table gives no rows. Errors stop at the
largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, small_side, written

#: Vectors of a block, which has a tree for each part, and points of a leaf.
BLOCK, LEAF = 4096, 32
LIMIT = 1 << 62
LONG_MAX = (1 << 63) - 1


def kept_rows(df: DataFrame, vector: str, parts: int) -> DataFrame:
    """(vec_id, label, v) of the rows that have a vector of finite components, a multiple of `parts` many."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 50)))
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int").alias("label")
    return df.select("vec_id", label, v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.coalesce(finite, F.lit(False)))


def _scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v); scale is a power of two, so that the product is exact."""
    x = np.floor(v * float(scale))
    return x.astype(np.int64) if np.abs(x).max(initial=0) < LIMIT else np.array([int(y) for y in x.ravel()], object).reshape(x.shape)


def _exact(points: int, dims: int, most: int):
    """The number type in which all of a block's sums and squared distances are exact."""
    span = max(dims * (4 * most + 4) ** 2, points * (most + 1))
    return np.float64 if span < 1 << 53 else np.int64 if span < 1 << 62 else object


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def build(points: np.ndarray) -> tuple:
    """A balanced kd-tree: (order, points in that order, bounds of the leaves, [(low, high, count, sum)] by level).

    Node i of level l holds the points from n*i/2^l on. Each level sorts every node along its widest side.
    """
    n, dims = points.shape
    depth = max(0, (n // LEAF).bit_length() - 1)
    order = np.arange(n)
    for level in range(depth):
        cut = (n * np.arange((1 << level) + 1)) >> level
        here = points[order]
        low, high = np.minimum.reduceat(here, cut[:-1]), np.maximum.reduceat(here, cut[:-1])
        side = np.argmax(high - low, 1)
        node = np.repeat(np.arange(1 << level), np.diff(cut))
        order = order[np.lexsort((here[np.arange(n), side[node]], node))]
    here = points[order]
    cut = (n * np.arange((1 << depth) + 1)) >> depth
    rows = [(np.minimum.reduceat(here, cut[:-1]), np.maximum.reduceat(here, cut[:-1]), np.diff(cut), np.add.reduceat(here, cut[:-1]))]
    for _ in range(depth):
        low, high, count, total = rows[0]
        rows.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), count[::2] + count[1::2], total[::2] + total[1::2]))
    return order, here, cut, rows


def assign(tree: tuple, book: np.ndarray, codes: bool = False) -> tuple:
    """(counts, sums) of the entries nearest to the tree's points, ties to the lower index; and each point's entry, in tree order, if asked."""
    _, here, cut, rows = tree
    n, dims = here.shape
    k = len(book)
    kind = _exact(n, dims, max(_most(here), _most(book)))
    big = {np.float64: np.inf, np.int64: LONG_MAX}.get(kind, 1 << 300)
    z, index, square = book.astype(kind), np.arange(k), lambda x: (x * x).sum(-1)
    counts, sums, got = np.zeros(k, np.int64), np.zeros((k, dims), kind), np.zeros(n, np.int64)
    nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, (low, high, count, total) in enumerate(rows):
        a, b = low[nodes].astype(kind), high[nodes].astype(kind)
        best = np.argmin(np.where(may, square(2 * z[None] - (a + b)[:, None]), big), 1)
        mine = z[best][:, None]
        corner = np.where(z[None] > mine, b[:, None], a[:, None])
        theirs, ours = square(z[None] - corner), square(mine - corner)
        may &= ~((theirs > ours) | ((theirs == ours) & (index > best[:, None])))
        one = may.sum(1) == 1
        whole, entry = nodes[one], best[one]
        hit = (entry[:, None] == index).astype(kind)
        counts += (hit.T @ count[whole].astype(kind)).astype(np.int64)
        sums = sums + hit.T @ total[whole].astype(kind)
        if codes:
            shift = len(rows) - 1 - level
            for node, e in zip(whole.tolist(), entry.tolist(), strict=True):
                got[cut[node << shift] : cut[(node + 1) << shift]] = e
        nodes, may = nodes[~one], may[~one]
        if level < len(rows) - 1:
            nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, 0)
    left = may.sum(1)
    for c in np.unique(left):
        some = nodes[left == c]
        entries = np.argsort(~may[left == c], 1, kind="stable")[:, :c]
        size = np.diff(cut)[some]
        at = cut[some][:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)
        p, e = here[at].astype(kind), z[entries]
        near = np.argmin(square(e)[:, None] - 2 * (p @ e.transpose(0, 2, 1)), 2)
        entry = np.take_along_axis(entries, near, 1)
        real = np.arange(size.max()) < size[:, None]
        entry, p, at = entry[real], p[real], at[real]
        hit = (entry[:, None] == index).astype(kind)
        counts += hit.sum(0).astype(np.int64)
        sums = sums + hit.T @ p
        got[at] = entry
    return counts, sums, got


def _forest(df: DataFrame, parts: int, scale: int) -> DataFrame:
    """One row for each block of vectors: its ids and labels, and the pickled trees of its parts."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    target = StructType([StructField("vec_id", ArrayType(fields["vec_id"])), StructField("label", ArrayType(fields["label"]))])
    schema = f"vec_id {target[0].dataType.simpleString()}, label {target[1].dataType.simpleString()}, trees binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                n = part.num_rows
                x = _scaled(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), scale)
                trees = []
                for piece in np.split(x, parts, 1):
                    order, here, cut, rows = build(piece)
                    small = here.astype(next(t for t in (np.int16, np.int32, np.int64) if _most(here) <= np.iinfo(t).max)) if here.dtype != object else here
                    trees.append((order.astype(np.uint16), small, cut, rows))
                row = [part.column(0).to_pylist()], [part.column(1).to_pylist()], [pickle.dumps(trees, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return df.select("vec_id", "label", "v").mapInArrow(run, schema)


def _round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry's parts give its floor(sum / count); unused entries stay."""
    schema = "part int, entry int, n long, place int, total decimal(38,0)"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(books), [0] * len(books)
        for batch in batches:
            for value in batch.column(0):
                for p, tree in enumerate(pickle.loads(value.as_buffer())):
                    n, total, _ = assign(tree, books[p])
                    counts[p] = counts[p] + n
                    sums[p] = sums[p] + total.astype(object if total.dtype == object else np.int64).astype(object)
        rows = [(p, e, int(counts[p][e]), i, Decimal(int(s))) for p in range(len(books)) if np.ndim(counts[p]) for e in np.flatnonzero(counts[p]).tolist() for i, s in enumerate(sums[p][e])]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, arrow, strict=True)], schema=arrow)

    moved = [b.astype(object) for b in books]
    sums = forest.select("trees").mapInArrow(run, schema).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sums.collect():  # as many rows as the codebooks have numbers
        moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return [m.astype(np.int64) for m in moved]


def _codes(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    fields = {f.name: f.dataType.elementType for f in forest.schema.fields if f.name != "trees"}
    schema = StructType([StructField("vec_id", fields["vec_id"]), StructField("label", fields["label"]), StructField("code", StringType()), StructField("error", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                codes, error = [], 0
                for tree, book in zip(pickle.loads(trees.as_buffer()), books, strict=True):
                    order, here = tree[0].astype(np.int64), tree[1]
                    _, _, got = assign(tree, book, codes=True)
                    kind = _exact(1, here.shape[1], max(_most(here), _most(book)))
                    kind = np.int64 if kind is np.float64 else kind
                    off = here.astype(kind) - book[got].astype(kind)
                    code, far = np.empty(len(order), np.int64), np.empty(len(order), kind)
                    code[order], far[order] = got, (off * off).sum(1)
                    codes.append(code)
                    error = error + far.astype(object if kind is object else np.int64)
                code = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, 1).tolist()]
                errors = [min(int(e), LONG_MAX) for e in error]
                columns = ids.values, labels.values, pa.array(code, pa.string()), pa.array(errors, pa.int64())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return forest.mapInArrow(run, schema)


def vector_codes(df: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    code has two hexadecimal digits for each part (entries: 256 at most). The first `entries` rows by id start the
    codebooks. label_error is the sum of the errors of the rows with an equal label, those without one together.
    """
    spark = df.sparkSession
    rows = kept_rows(df, vector, parts)
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).first()
    dims = len(first["v"]) if first else parts
    rows = rows.where(F.size("v") == dims)
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = _scaled(np.array([r["v"] for r in start], float).reshape(len(start), dims), scale)
    books = [b.astype(np.int64) for b in np.split(seeds, parts, 1)]
    if not start:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    forest, at = written(_forest(rows, parts, scale))
    for _ in range(rounds):
        books = _round(forest, books)
    coded, _ = written(_codes(forest, books))
    discard(spark, at)
    said = ",".join(str(int(x)) for b in books for x in b.ravel())
    summed = coded.groupBy("label").agg(_sum("error").alias("label_error"))
    labels, _ = written(summed.withColumnRenamed("label", "_label"))
    joined = coded.join(small_side(labels), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


def _sum(name: str) -> Column:
    """The sum of longs, at most the largest long."""
    return F.least(F.sum(F.col(name).cast("decimal(20,0)")), F.lit(Decimal(LONG_MAX))).cast("long")
