"""Exact top-k search by inner product, by sorted lists without random access.

Candidates are dealt to buckets of a fixed number of rows, queries to blocks.  A bucket keeps, for each
component, a list of its candidates sorted by that component; a query reads a list from
the top where its own component is positive, from the end where it is negative.  Lists are read in
steps.  After a step a candidate has a lower and an upper bound: what has been read of it, plus for
each list where it has not come up yet the least value of the list, or the last one read.  An
outsider whose upper bound is below the k-th best lower bound is out.  Reading stops
when few are left beside the best; their scores are then resolved from the whole vectors, and
the k best of each bucket are merged over all buckets.

Queries that stop early leave the block, and so do candidates that are out for every query left, so later
steps read for fewer of both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, staged
from .vector_search import _by_length

#: Queries of a block and candidates of a bucket; a block is worked off in tiles of so many queries.
BLOCK_QUERIES, BUCKET_ROWS, TILE_QUERIES = 8192, 4096, 512
#: Steps in which lists are read to their ends.
STEPS = 8
#: Reading stops for a query with so many candidates left; resolving these is cheaper than another step.
FEW = 64
#: Scores beyond a long count as its ends.
_LEAST, _MOST = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component) as long, of vectors that are not null and have finite components only."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    # Beyond the range of a long there are no fractions, and floor() would not fit.
    cut = lambda v: F.greatest(F.least(v * F.lit(float(scale)), F.lit(2.0**62)), F.lit(-(2.0**62)))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .where(finite)
        .select("vec_id", F.transform("x", lambda v: F.floor(cut(v))).alias("x"))
    )


class Lists:
    """The sorted lists of one bucket: for each component the order of the candidates, from the top and from the end."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        self.ids, self.y = ids, y
        self.n, self.d = y.shape
        order = np.argsort(-y, axis=0, kind="stable")
        self.place = np.empty_like(order)  # of a candidate in each list, from the top
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)
        self.values = np.take_along_axis(y, order, axis=0)  # each list from the top
        self.largest = int(np.abs(y.astype(np.float64)).max()) if y.size else 0

    def read(self, depth: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After depth rows of each list, from the top and then from the end: values read (0 if not), whether unread, last value read, least value."""
        last = self.n - 1
        unread = np.concatenate([self.place >= depth, self.place <= last - depth], axis=1)
        known = np.where(unread, 0, np.concatenate([self.y, self.y], axis=1)).astype(kind)
        front = np.concatenate([self.values[min(depth, last)], self.values[max(last - depth, 0)]]).astype(kind)
        least = np.concatenate([self.values[last], self.values[0]]).astype(kind)
        return known, unread.astype(kind), front, least


def _resolved(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of x with the same rows of y, whole numbers; a long's ends stand for what is beyond."""
    if exact:
        return (x * y).sum(1)
    full = [sum(a * b for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array([min(max(s, _LEAST), _MOST) for s in full], np.int64)


def best_of_bucket(lists: Lists, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of the bucket, score) of the k best of the bucket for each query, ties to the smaller id; repeated ids are all there."""
    reach = float(lists.largest) * float(np.abs(x.astype(np.float64)).max() if x.size else 0) * max(lists.d, 1)
    # Whole numbers that single or double precision holds exactly; beyond, bounds get room for rounding.
    kind = np.float32 if reach < 2**23 else np.float64
    slack = 0.0 if reach < 2**52 else reach * 1e-12
    sides = np.concatenate([np.maximum(x, 0), np.minimum(x, 0)], axis=1).astype(kind)
    same = ids[:, None] == lists.ids[None, :] if np.isin(ids, lists.ids).any() else None
    # Ids that repeat in a bucket fill places of the k best without being further results.
    spare = lists.n - len(np.unique(lists.ids))
    rows, columns = np.arange(len(ids)), np.arange(lists.n)
    left: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, STEPS + 1):
        depth = -(-lists.n * step // STEPS)
        known, unread, front, least = lists.read(depth, kind)
        q, known, unread = sides[rows], known[columns], unread[columns]
        have = q @ known.T
        lower, upper = have + (q * least) @ unread.T, have
        upper += (q * front) @ unread.T
        if same is not None:
            own = same[np.ix_(rows, columns)]
            lower[own], upper[own] = -np.inf, -np.inf
        best = min(k + spare, len(columns))
        limit = np.partition(lower, len(columns) - best, axis=1)[:, len(columns) - best] - slack if best == k + spare else np.full(len(rows), -np.inf)
        in_reach = (upper >= limit[:, None]) & (upper > -np.inf)
        counts = in_reach.sum(1)
        stopped = (counts <= FEW + best) | (depth >= lists.n)
        if stopped.any():
            a, b = np.nonzero(in_reach[stopped])
            left.append((rows[stopped][a], columns[b]))
            rows, in_reach = rows[~stopped], in_reach[~stopped]
        if not len(rows):
            break
        columns = columns[in_reach.any(0)]  # the k best lower bounds of every query left are among them
    a, b = (np.concatenate(z) for z in zip(*left, strict=True)) if left else (np.zeros(0, int), np.zeros(0, int))
    score = np.concatenate([np.zeros(0, np.int64), *(_resolved(x[a[i : i + 65536]], lists.y[b[i : i + 65536]], reach < 2**62) for i in range(0, len(a), 65536))])
    order = np.lexsort((lists.ids[b], ~score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k + spare
    return a[keep], b[keep], score[keep]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
    block: int = BLOCK_QUERIES, bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """For each row of queries the k rows of vectors with the largest inner product: query_id, rank, vec_id, score.

    Components count as floor(scale * component), components beyond 2 ** 62 as that; scores are
    exact whole numbers, beyond the range of a long its ends.  Ties go to the smaller vec_id.  A
    query has fewer than k rows if there are fewer candidates; rows with its own vec_id are no
    candidates, nor are vectors of another length than its own.  Zero and empty vectors
    take part (with scores of zero); rows with a null id, null vectors, and vectors with a null or
    non-finite component do not.  Of rows that repeat an id the best counts.  Further columns
    are not read.  No queries or no candidates give no rows.
    """
    points = whole_vectors(vectors, id_column, vector_column, scale)
    asked = staged(whole_vectors(queries, id_column, vector_column, scale).dropDuplicates(["vec_id", "x"]), "queries")
    blocks, buckets = parts_for(asked.count(), max(1, block // 2)), parts_for(points.count(), bucket)
    own = lambda column, n: F.pmod(F.xxhash64(*column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("vec_id", "x", own(["vec_id"], blocks).alias("block"), every(buckets).alias("bucket"))
    points = points.select("vec_id", "x", own(["vec_id", "x"], buckets).alias("bucket"), every(blocks).alias("block"))

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if one.num_rows and other.num_rows:
            of = lambda t: {d: (i, x) for d, i, x in _by_length(t.column("vec_id").combine_chunks().to_numpy(), t.column("x").combine_chunks())}
            there = of(other)
            for d, (ids, x) in of(one).items():
                if d in there:
                    lists = Lists(*there[d])
                    for low in range(0, len(ids), TILE_QUERIES):
                        tile = ids[low : low + TILE_QUERIES]
                        a, b, score = best_of_bucket(lists, tile, x[low : low + TILE_QUERIES], k)
                        found.append((tile[a], lists.ids[b], score))
        q, v, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    pairs = asked.groupBy("block", "bucket").cogroup(points.groupBy("block", "bucket"))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB's SQL for the k best of each vector whose id is divisible by every."""
    return f"""
WITH given AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
fit AS (
  SELECT vec_id, list_transform(x, lambda v: CAST(floor({scale} * v) AS BIGINT)) AS x
  FROM given WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM fit q JOIN fit c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs) WHERE place <= {k}
"""
