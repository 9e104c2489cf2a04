"""SimHash near-duplicates: fingerprints compared exactly, tile by tile.

Fingerprints are computed where the text lies and equal ones are folded before
anything is compared, so a group of exact copies is one fingerprint.  Comparing
is exact: bits are cut into radius + e blocks, two fingerprints within the radius
agree on at least e of them, so every set of e blocks deals the fingerprints to
tiles by the value of those blocks.  e grows with the number of fingerprints, which
keeps tiles at a bounded size; a tile that is still large (a family of near copies)
is split into sub-tiles by population count, and only pairs of sub-tiles whose
population counts can lie within the radius meet.  In a tile, rows are sorted by
population count and numpy compares them by exclusive-or and bit counts; a row is
left as soon as the population counts differ by more than the radius.  Each tile
reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import parts_for, staged, text_or_empty

#: Fingerprints of one tile at most, and rows of one Python group.
TILE = 4096
GROUP_ROWS = 40_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _majority(hashes: np.ndarray, doc: np.ndarray, docs: int, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of docs documents; hash i belongs to document doc[i]."""
    out = np.zeros(docs, np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        table = np.bincount(doc * 256 + octets[:, k], minlength=docs * 256).reshape(docs, 256)
        bits = (table @ _BITS) * 2 > counts[:, None]
        out |= (bits.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def fingerprints_of(texts: list[str | None], width: int) -> np.ndarray:
    """SimHash of each text over its shingles of width words, as unsigned 64 bits."""
    digest, glue = xxhash.xxh64_intdigest, b" ".join
    result = np.zeros(len(texts), np.uint64)
    for low in range(0, len(texts), 256):
        part, hashes, counts = texts[low : low + 256], [], []
        for text in part:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if len(words) >= width:
                own = [digest(glue(s), 42) for s in zip(*(words[k:] for k in range(width)), strict=False)]
            else:
                own = [digest(glue(words), 42)] if words else []
            hashes += own
            counts.append(len(own))
        counts = np.array(counts, np.int64)
        if hashes:
            doc = np.repeat(np.arange(len(part)), counts)
            result[low : low + 256] = _majority(np.array(hashes, np.uint64), doc, len(part), counts)
    return result


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp); one narrow pass, fp as a signed long."""

    def run(batches):
        for batch in batches:
            fps = fingerprints_of(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(radius: int, agree: int) -> list[int]:
    """Signed masks of every set of agree blocks out of radius + agree."""
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    whole = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(c) for c in combinations(whole, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_to_agree(fingerprint_count: int, radius: int, tile: int = TILE) -> int:
    """Least e whose tiles of 64 e / (radius + e) bits hold tile fingerprints or fewer if spread evenly."""
    for agree in range(1, 5):
        if fingerprint_count >> (64 * agree // (radius + agree)) <= tile // 4:
            return agree
    return 5


class _Forest:
    """Disjoint sets over rows of one Python group."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        lab = self.labels()
        apart = lab[a] != lab[b]
        if apart.any():
            pairs = np.unique(np.stack([lab[a[apart]], lab[b[apart]]], 1), axis=0)
            for x, y in pairs.tolist():
                x, y = self._root(x), self._root(y)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)


def forest_of_tiles(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within tiles: rows of one group value form a tile, or with sides 0 and 1 a pair of sub-tiles."""
    count = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((count, side, group))
    group, side, fp, count = group[order], side[order], fp[order], count[order]
    forest = _Forest(len(fp))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(fp)]
    crossing = np.zeros(len(fp), bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        paired = side[e - 1] != 0
        if not paired and e - s <= 256:
            continue
        crossing[s:e] = True
        cut = s + int(np.searchsorted(side[s:e], 1)) if paired else e
        for low in range(s, cut, 128):
            high = min(cut, low + 128)
            begin = cut if paired else low
            first = begin + int(np.searchsorted(count[begin:e], count[low] - radius))
            last = begin + int(np.searchsorted(count[begin:e], count[high - 1] + radius, "right"))
            near = np.bitwise_count(fp[low:high, None] ^ fp[None, first:last]) <= radius
            i, j = np.nonzero(near)
            i, j = i + low, j + first
            apart = i != j
            forest.link(i[apart], j[apart])
    left, step = np.flatnonzero(~crossing), 1
    while len(left):
        left = left[left + step < len(fp)]
        right = left + step
        meets = (group[left] == group[right]) & (count[right] - count[left] <= radius)
        left, right = left[meets], right[meets]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        forest.link(left[near], right[near])
        step += 1
    root = forest.labels()
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def near_links(distinct: DataFrame, total: int, radius: int, tile: int = TILE) -> DataFrame:
    """distinct (fp) -> (a, b): links within the radius, enough of them to connect every family."""
    masks = _masks(radius, blocks_to_agree(total, radius, tile))
    dealt = distinct.select(
        "fp",
        F.bit_count("fp").alias("ones"),
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "value"),
    )
    large = dealt.groupBy("block", "value").count().where(F.col("count") > tile).select("block", "value", "count")
    marked = dealt.join(large, ["block", "value"], "left")
    plain = marked.where("count is null").select(
        F.xxhash64("block", "value").alias("tile"), F.lit(0).alias("side"), "fp"
    )
    # Sub-tiles of a large tile: by population count, then by hash.
    split = marked.where("count is not null").drop("count")
    per_count = split.groupBy("block", "value", "ones").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("n"))
    subs = per_count.select("block", "value", "ones", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub"))
    other = subs.select("block", "value", F.col("ones").alias("ones2"), F.col("sub").alias("sub2"))
    pairs = subs.join(other, ["block", "value"]).where(
        (F.col("ones2") - F.col("ones") <= radius)
        & ((F.col("ones") < F.col("ones2")) | ((F.col("ones") == F.col("ones2")) & (F.col("sub") <= F.col("sub2"))))
    )
    pairs = pairs.withColumn("tile", F.xxhash64("block", "value", "ones", "sub", "ones2", "sub2"))
    same = (F.col("ones") == F.col("ones2")) & (F.col("sub") == F.col("sub2"))
    seats = pairs.select("block", "value", "ones", "sub", "tile", F.lit(0).alias("side")).unionByName(
        pairs.where(~same).select(
            "block", "value", F.col("ones2").alias("ones"), F.col("sub2").alias("sub"), "tile", F.lit(1).alias("side")
        )
    )
    seated = (
        split.join(per_count, ["block", "value", "ones"])
        .withColumn("sub", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
        .join(seats, ["block", "value", "ones", "sub"])
        .select("tile", "side", "fp")
    )
    rows = plain.unionByName(seated)
    groups = parts_for(total * len(masks), GROUP_ROWS)

    def compare(table: pa.Table) -> pa.Table:
        a, b = forest_of_tiles(
            table.column("tile").to_numpy(), table.column("side").to_numpy(), table.column("fp").to_numpy().view(np.uint64), radius
        )
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt_out = rows.withColumn("part", F.pmod("tile", F.lit(groups)))
    return dealt_out.groupBy("part").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per input row: doc_id, fp, component_id.

    Null and empty texts have fingerprint zero and link like any other.  component_id
    is the least doc_id reachable through links; rows whose doc_id is null are linked
    too and do not lower it (a component of null ids only has a null id).  Repeated
    rows give repeated rows; other columns are not read; no rows give no rows.
    """
    fps = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), distinct.count(), radius, tile)
    forest = components(links).select(F.col("node").alias("fp"), "root")
    linked = staged(distinct.join(forest, "fp"), "linked-fingerprints")
    roots = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    component = linked.join(roots, "root").select("fp", "component_id")
    alone = distinct.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    # Written first, so that the rows of a hot fingerprint are split by Spark: both sides of this join are plain exchanges.
    return fps.join(staged(component.unionByName(alone), "components"), "fp").select("doc_id", "fp", "component_id")
