"""Nearest neighbours by inner product, as a block matrix join.

Vectors are packed into blocks, and blocks of queries and of candidates are dealt to the cells of a grid, so that every
query meets every candidate in one cell and a cell holds about CELL_BYTES of either side. In a cell both sides are
quantised to int8, each vector with a scale of its own. Tiles of their product give the inner products up to an error
that is bounded for each pair:

    |x . y - sx sy (kx . ky)| <= |x| |ey| + |ex| |sy ky|        (x = sx kx + ex, y = sy ky + ey)

Products of int8 are multiplied as whole numbers in single precision, which is exact for up to EXACT components at once.
A pair survives a tile if its upper bound reaches the nearest ``k``-th exact score that its query has so far (in a query's
first tile: the k-th lower bound). Survivors are computed again in double precision, component by component in order, and
enter their query's heap of k. The heaps of all cells are merged by a ranking that each task cuts to k before the shuffle.
The result is exact: bounds only decide what is computed again, so recall is 1. The bounds allow for rounding.

Equal vectors tie with any query, so of one vector's candidates only those with the k + 1 smallest ids can be found (a
query is no candidate of its own); no other is sent to the grid. So a vector that very many rows share costs as much as k + 1 rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat in id and vector are one; of different vectors with one id each is compared, and a pair of
ids scores the larger; vectors of different lengths don't meet; with fewer than k candidates all are found; ties go to the
smaller id; an empty table gives an empty table; other columns are not read. Of vectors of doubles the components' sizes must
lie within 1e-150 and 1e150, so that products are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import pretoken
from tessera.runtime import materialise, row_key

FOUND = 20
#: Bytes of vectors of either side in a cell, and rows of a block that is packed before.
CELL_BYTES, BLOCK_ROWS = 32 << 20, 4096
#: Queries and candidates of a tile, and pairs computed again at once.
TILE_QUERIES, TILE_ROWS, PAIRS = 256, 4096, 1 << 16
#: Components whose products of int8 add up exactly in single precision: 127 * 127 * EXACT < 2 ** 24.
EXACT = 1024
#: Part of a product of lengths that rounding in single and double precision stays below.
ROUNDING = 1e-5
LEVELS = 127


def usable(v: Column) -> Column:
    """Vectors that take part."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 levels, scale, length of the levels times the scale, and length of the error, of each row of doubles."""
    scale = np.abs(x).max(1) / LEVELS
    levels = np.rint(x / scale[:, None])
    near = levels * scale[:, None]
    return levels.astype(np.int8), scale, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 levels, in single precision; in double where a row has more than EXACT components."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T, np.float64), np.ascontiguousarray(b.T, np.float64), strict=True):
        total += x * y
    return total


def first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest different ids of each group, in order: by score, then by id."""
    order = np.lexsort((-score, ids, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[new]
    order = order[np.lexsort((ids[order], -score[order], group[order]))]
    g = group[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < k]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k nearest of each query, exact; a row never meets its own id."""
    # a unit of its own for each side keeps lengths of any size within single precision
    q_unit, x_unit = np.abs(q).max().astype(np.float64), np.abs(x).max().astype(np.float64)
    order = np.argsort(-np.abs(x).max(1), kind="stable")  # tiles of like lengths have like error bounds
    ids, x = ids[order], x[order]
    heap_q, heap_id, heap_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for a in range(0, len(q), TILE_QUERIES):
        own, own_ids = q[a : a + TILE_QUERIES], q_ids[a : a + TILE_QUERIES]
        ql, qs, qn, qe = quantise(own / q_unit)
        at, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        reached = np.full(len(own), -np.inf)
        for b in range(0, len(x), TILE_ROWS):
            some, some_ids = x[b : b + TILE_ROWS], ids[b : b + TILE_ROWS]
            xl, xs, xn, xe = quantise(some / x_unit)
            near = product(ql, xl)
            near *= xs.astype(near.dtype)
            length = (qn + qe) * (xn + xe).max()
            error = ((qn + qe) * xe.max() + qe * xn.max() + ROUNDING * length) / qs + 1e-30
            near[own_ids[:, None] == some_ids[None, :]] = -np.inf
            bar = (reached / (q_unit * x_unit)) / qs - error
            first = np.isinf(reached) & (reached < 0)
            if first.any() and len(some) > k:
                # ids that repeat can't count twice for the k-th lower bound
                _, once = np.unique(some_ids, return_index=True)
                if len(once) > k:
                    kth = np.partition(near[np.ix_(first, once)], len(once) - k, axis=1)[:, len(once) - k]
                    bar[first] = np.where(np.isfinite(kth), kth - 2 * error[first], -np.inf)
            row, col = np.nonzero(near >= np.maximum(bar, -1e300)[:, None])
            for c in range(0, len(row), PAIRS):
                r, j = row[c : c + PAIRS], col[c : c + PAIRS]
                at, found, score = np.append(at, r), np.append(found, some_ids[j]), np.append(score, inner(own[r], some[j]))
                keep = first_k(at, score, found, k)
                at, found, score = at[keep], found[keep], score[keep]
            full = np.bincount(at, minlength=len(own)) == k
            last = np.append(at[1:] != at[:-1], True) if len(at) else np.empty(0, bool)
            reached[full] = score[last][full[at[last]]]
        heap_q, heap_id, heap_s = np.append(heap_q, a + at), np.append(heap_id, found), np.append(heap_s, score)
    return heap_q, heap_id, heap_s


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to blocks of vectors of one length: dim, n, ids, vectors."""

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            row = [[int(dim)], [len(at)], [ids[at].astype("<i8").tobytes()], [flat.astype(flat.dtype.newbyteorder("<")).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "n", "ids", "vectors"])

    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            yield from blocks(batch.slice(i, BLOCK_ROWS))


def _unpack(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in table["ids"].to_pylist()])
    flat = np.concatenate([np.frombuffer(x, kind) for x in table["vectors"].to_pylist()])
    return ids, flat.reshape(len(ids), -1)


def search(df: DataFrame, is_query: Column | str, k: int = FOUND, id_col: str = "vec_id", vector_col: str = "embedding", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, rank, the neighbour's id and score: for each row that ``is_query`` (of the id) the k nearest others."""
    spark = df.sparkSession
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind, item = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    k1, k2 = row_key(rows, ["v"])
    rows = rows.select("id", "v", k1.alias("k1"), k2.alias("k2"))
    rows = materialise(rows.groupBy("id", "k1", "k2").agg(F.first("v").alias("v")), "vectors")
    alike = Window.partitionBy("k1", "k2").orderBy("id")
    candidates = rows.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k + 1)
    schema = "dim int, n long, ids binary, vectors binary"
    packed = lambda part: materialise(part.select("id", "v").mapInArrow(_pack, schema).withColumn("block", F.xxhash64("ids", "dim")), "vector-blocks")
    asked, others = packed(rows.where(is_query)), packed(candidates)
    most = spark.sparkContext.defaultParallelism

    def parts(blocks: DataFrame, split: int) -> int:
        size, n = blocks.agg(F.sum(F.octet_length("vectors")), F.count(F.lit(1))).first()
        return max(1, -(-(size or 0) // cell_bytes), min(split, n))

    # a small table has a cell for each core at least, if it has so many blocks
    n_rows, n_cols = parts(asked, 1), parts(others, most)
    number = lambda n: F.pmod(F.col("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("dim", "ids", "vectors", number(n_rows).alias("i"), every(n_cols).alias("j"))
    right = others.select("dim", "ids", "vectors", every(n_rows).alias("i"), number(n_cols).alias("j"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        pretoken.lean()
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if q.num_rows and c.num_rows:
            (q_ids, q_v), (ids, v) = _unpack(q, item), _unpack(c, item)
            at, near, score = nearest(q_ids, q_v, ids, v, k)
            found = [q_ids[at], near, score]
        pretoken.give_back()
        return pa.table(found, names=["query_id", id_col, "score"])

    heaps = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(cell, f"query_id long, `{id_col}` long, score double")
    one = heaps.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return one.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
