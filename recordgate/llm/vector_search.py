"""Nearest neighbours by a block matrix join on int8 tiles.

Vectors are rounded to int8 once, with one scale each.  Queries are cut into blocks and candidates into buckets of
a fixed number of rows, by hash.  Each pair of a block and a bucket meets in one group, and only rounded
vectors travel there, with their scales and the lengths of what rounding took; queries are sent once for a bucket,
candidates once for a block.  The block is multiplied with the bucket's rows, tile by tile; products of int8
vectors are whole numbers, which single precision holds exactly up to 1024 components (double precision beyond).  With the
length e of what rounding took from each vector, the true distance lies within
e_query + e_candidate of the distance between the rounded ones, so a candidate whose
lower bound exceeds the k-th best upper bound is out, in its group first and then over all groups.  The
pairs left, a few for each of the k and of vectors that many rows share only the first ones, get their original vectors by two joins, are recomputed in
double precision, and the k nearest of each query are kept.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, staged

#: Queries of a block and candidates of a bucket, 4 and 8 MB at 1024 components of a byte; candidates of a tile.
BLOCK_QUERIES, BUCKET_ROWS = 4096, 8192
TILE_ROWS = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x): vectors that are not null, zero or empty and have finite components only."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(finite & F.exists("x", lambda v: v != 0))
    )


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the lengths of the rounding errors."""
    scale = np.abs(x).max(1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q, scale, error


class QueryBlock:
    """Rounded query vectors of one length, with a heap of the k least upper bounds for each, and the pairs within reach so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, scale: np.ndarray, error: np.ndarray, k: int):
        self.ids, self.q, self.scale, self.error, self.k = ids, q, scale, error, k
        # Sums of d products of int8 values stay below 2 ** 24 up to d = 1024.
        self.kind = np.float32 if q.shape[1] <= 1024 else np.float64
        self.square = (q.astype(np.float64) ** 2).sum(1) * scale**2
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.limit = np.full(len(ids), np.inf)
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, ids: np.ndarray, q: np.ndarray, scale: np.ndarray, error: np.ndarray) -> None:
        dots = self.q.astype(self.kind) @ q.astype(self.kind).T
        square = (q.astype(np.float64) ** 2).sum(1) * scale**2
        near = self.square[:, None] + square[None, :] - 2.0 * dots.astype(np.float64) * (self.scale[:, None] * scale[None, :])
        near = np.sqrt(np.maximum(near, 0.0))  # of no use where squares overflow: such pairs are always recomputed
        # A little room for the rounding of this arithmetic itself.
        slack = (self.error[:, None] + error[None, :]) + 1e-9 * (np.sqrt(self.square)[:, None] + np.sqrt(square)[None, :]) + 1e-300
        same = self.ids[:, None] == ids[None, :]
        unknown = ~np.isfinite(near) | ~np.isfinite(slack)
        upper = np.where(same | unknown, np.inf, near + slack)
        lower = np.where(unknown, 0.0, np.maximum(near - slack, 0.0))
        limit = self.limit
        if len(ids) >= self.k and len(np.unique(ids)) == len(ids):
            limit = np.minimum(limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((lower <= limit[:, None]) & ~same)
        if not len(rows):
            return
        self.pairs.append((rows, ids[columns], lower[rows, columns], upper[rows, columns]))
        for i, j, u in zip(rows.tolist(), ids[columns].tolist(), upper[rows, columns].tolist(), strict=True):
            self._put(self.heaps[i], (-u, -j))
        for i in np.unique(rows).tolist():
            if len(self.heaps[i]) == self.k:
                self.limit[i] = -self.heaps[i][0][0]

    def _put(self, heap: list, entry: tuple[float, int]) -> None:
        if len(heap) == self.k and entry <= heap[0]:
            return
        for n, other in enumerate(heap):
            if other[1] == entry[1]:  # the same id again: the nearer row counts
                if entry > other:
                    heap[n] = entry
                    heapq.heapify(heap)
                return
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heapreplace(heap, entry)

    def found(self) -> list[np.ndarray]:
        """query_id, vec_id, lower and upper of the pairs that are still within reach at the end."""
        if not self.pairs:
            return []
        rows, ids, lower, upper = (np.concatenate(z) for z in zip(*self.pairs, strict=True))
        on = lower <= self.limit[rows]
        return [self.ids[rows[on]], ids[on], lower[on], upper[on]]


def rounded(points: DataFrame) -> DataFrame:
    """(vec_id, x) -> vec_id, d, q (int8 components as bytes), scale, error, h (a hash of x)."""

    def run(batches):
        for batch in batches:
            for d, ids, x in _by_length(np.arange(batch.num_rows), batch.column(1)):
                with np.errstate(over="ignore", invalid="ignore"):
                    q, scale, error = quantized(x)
                octets = np.ascontiguousarray(q).view(np.uint8).reshape(-1)
                places = (np.arange(len(ids) + 1) * d).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(octets)])
                own, h = (batch.column(c).take(pa.array(ids)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(ids), d, np.int32)), packed, pa.array(scale), pa.array(error), h], ["vec_id", "d", "q", "scale", "error", "h"])

    return points.select("vec_id", "x", F.xxhash64("x").alias("h")).mapInArrow(run, "vec_id long, d int, q binary, scale double, error double, h long")


def first_alike(ids: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """Rows whose id is among the most smallest ones of all rows with the same vector; a repeated id counts once.

    No other row can be among the nearest of any query: ties go to the smaller id.
    """
    order = np.lexsort((ids, h))
    a, b = h[order], ids[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    order, a = order[new], a[new]
    return np.sort(order[np.arange(len(a)) - np.searchsorted(a, a) < most])


def _rounded_by_length(table: pa.Table):
    """(length, ids, int8 rows, scales, errors) of a group's rows."""
    d = table.column("d").to_numpy()
    for n in np.unique(d).tolist():
        part = table.filter(pa.array(d == n)) if (d != n).any() else table
        octets = b"".join(part.column("q").to_pylist())
        yield n, part.column("vec_id").to_numpy(), np.frombuffer(octets, np.int8).reshape(-1, n), part.column("scale").to_numpy(), part.column("error").to_numpy(), part.column("h").to_numpy()


def _by_length(ids: np.ndarray, lists: pa.ListArray):
    """Rows of a batch by the length of their vectors."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, ids[at], values[offsets[at][:, None] + np.arange(d)[None, :]]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    block: int = BLOCK_QUERIES,
) -> DataFrame:
    """For each row of queries its k nearest in vectors: query_id, rank, vec_id, score.

    score: Euclidean distance in double precision.  Ties go to the smaller vec_id.  A
    query has fewer than k rows if there are fewer candidates; its own vec_id is no
    candidate.  Vectors of another length than the query's are no candidates.  Rows
    with a null id, and vectors null, empty, zero or with a null or non-finite
    component, take no part; of rows that repeat an id the nearest counts.  Further
    columns are not read.  No queries or no candidates give no rows.
    """
    points = usable(vectors, id_column, vector_column)
    asked = staged(usable(queries, id_column, vector_column).dropDuplicates(["vec_id", "x"]), "queries")
    small, small_asked = (staged(rounded(df), name) for df, name in ((points, "rounded-vectors"), (asked, "rounded-queries")))
    # Rows are dealt by hash; a block or a bucket holds about so many rows at any size of the table.
    blocks, buckets = parts_for(small_asked.count(), max(1, block // 2)), parts_for(small.count(), BUCKET_ROWS)
    own = lambda column, n: F.pmod(F.xxhash64(*column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = ["vec_id", "d", "q", "scale", "error", "h"]
    sides = small_asked.select(*row, own(["vec_id"], blocks).alias("block"), every(buckets).alias("bucket")), small.select(*row, own(["vec_id", "q"], buckets).alias("bucket"), every(blocks).alias("block"))

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        by_length = {d: QueryBlock(i, q, s, e, k) for d, i, q, s, e, _ in _rounded_by_length(one)} if one.num_rows and other.num_rows else {}
        if by_length:
            for d, i, q, s, e, h in _rounded_by_length(other):
                if d in by_length:
                    some = first_alike(i, h, k + 1)  # one more, as a query's own row is none of its nearest
                    for low in range(0, len(some), TILE_ROWS):
                        with np.errstate(over="ignore", invalid="ignore"):
                            by_length[d].offer(*(v[some[low : low + TILE_ROWS]] for v in (i, q, s, e)))
        rows = [found for b in by_length.values() if (found := b.found())]
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())]
        columns = [np.concatenate(z) for z in zip(*rows, strict=True)] if rows else [[], [], [], []]
        return pa.table({n: pa.array(v, kind) for (n, kind), v in zip(kinds, columns, strict=True)})

    pairs = sides[0].groupBy("block", "bucket").cogroup(sides[1].groupBy("block", "bucket"))
    within = staged(pairs.applyInArrow(compare, "query_id long, vec_id long, lower double, upper double").groupBy("query_id", "vec_id").agg(F.min("lower").alias("lower"), F.min("upper").alias("upper")), "near-pairs")
    # The k-th least upper bound of a query over all groups; a query with fewer candidates keeps all.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("upper", "vec_id"))
    limits = within.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.max("upper").alias("most"), F.count("*").alias("n"))
    left = within.join(limits, "query_id").where((F.col("n") < k) | (F.col("lower") <= F.col("most"))).select("query_id", "vec_id")
    first, second = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("a")), points.select("vec_id", F.col("x").alias("b"))
    exact = left.join(first, "query_id").join(second, "vec_id").where(F.size("a") == F.size("b"))
    # Squares are added in the order of the components.
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    scored = exact.select("query_id", "vec_id", F.sqrt(square).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_sql(k: int = 10, every: int = 100) -> str:
    """DuckDB's SQL for the k nearest of each vector whose id is divisible by every."""
    return f"""
WITH given AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
fit AS (SELECT * FROM given WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))) AS score
  FROM fit q JOIN fit c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM pairs) WHERE place <= {k}
"""
