"""Suffix-array dedup: bytes covered by a string of 200 that also starts anywhere else.

Suffixes that can share 200 bytes are brought together by their anchors (anchors.py).
Among the representatives of one anchor, the suffixes that start there are put in
order by deep-shallow sorting, and likewise the reversed texts before it; neighbours'
common prefixes say how far any two agree to the right and to the left.  Two places
that agree over left + right >= 200 bytes repeat all of these, so a representative's
repeated bytes are one run around its anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .shared import parts_for, staged
from .suffix_sort import deep_shallow_order, neighbour_prefixes

GRAM = 40
#: Representatives of one anchor that a task sorts; windows of larger ones are counted one by one.
GROUP = 50_000
#: Representatives of one Python group.
GROUP_ROWS = 10_000
_PAIRS = 400


def _agreements(order: list[int], prefixes: list[int]) -> np.ndarray:
    """Matrix of common prefix lengths between any two strings, by number."""
    n = len(order)
    lcp = np.array(prefixes, np.int32)
    by_place = np.zeros((n, n), np.int32)
    for i in range(n - 1):
        by_place[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
    by_place = np.maximum(by_place, by_place.T)
    matrix = np.zeros((n, n), np.int32)
    matrix[np.ix_(order, order)] = by_place
    return matrix


def repeated_reach(befores: list[bytes], afters: list[bytes], width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the bytes before and from its anchor that lie in windows some other place has too; 0, 0 if none."""
    n = len(afters)
    lefts = [b[::-1] for b in befores]
    order_r, order_l = deep_shallow_order(afters, shallow), deep_shallow_order(lefts, shallow)
    prefix_r, prefix_l = neighbour_prefixes(afters, order_r), neighbour_prefixes(lefts, order_l)
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= _PAIRS:
        right, left = _agreements(order_r, prefix_r), _agreements(order_l, prefix_l)
        good = left + right >= width
        np.fill_diagonal(good, False)
        return np.where(good, left, 0).max(1, initial=0), np.where(good, right, 0).max(1, initial=0)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[order_r], rank_l[order_l] = np.arange(n), np.arange(n)
    lcp_r, lcp_l = np.array(prefix_r), np.array(prefix_l)
    for step in range(max(map(len, lefts)) + 1):
        # Windows that start step bytes before the anchor: equal if both parts are.
        class_r, class_l = np.cumsum(lcp_r < width - step)[rank_r], np.cumsum(lcp_l < step)[rank_l]
        _, group, count = np.unique(class_r * (n + 1) + class_l, return_inverse=True, return_counts=True)
        again = count[group] > 1
        reach_l[again] = step
        reach_r[again] = np.maximum(reach_r[again], width - step)
    return reach_l, reach_r


def _sorted_groups(table: pa.Table):
    """Rows of a table ordered by gram and place, each place once, with the bounds of each gram's rows."""
    columns = [table.column(c).to_numpy() for c in ("gram", "doc", "th", "pos")]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new |= np.concatenate([[True], c[1:] != c[:-1]])
    order = order[new]
    gram = columns[0][order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return order, starts, np.concatenate([starts[1:], [len(order)]])


def _compare(width: int, shallow: int):
    def compare(table: pa.Table) -> pa.Table:
        doc, th, low, high = [], [], [], []
        if table.num_rows:
            order, starts, ends = _sorted_groups(table)
            befores, afters = table.column("before").to_pylist(), table.column("after").to_pylist()
            docs, ths, pos = (table.column(c).to_numpy() for c in ("doc", "th", "pos"))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                rows = order[s:e]
                if len(rows) < 2:
                    continue
                left, right = repeated_reach([befores[r] for r in rows], [afters[r] for r in rows], width, shallow)
                hit = np.flatnonzero(right)
                rows = rows[hit]
                doc.append(docs[rows]), th.append(ths[rows])
                low.append(pos[rows] - left[hit]), high.append(pos[rows] + right[hit])
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        return pa.table({"doc": join(doc, np.int64), "th": join(th, np.int64), "low": join(low, np.int32), "high": join(high, np.int32)})

    return compare


def repeat_intervals(documents: DataFrame, shape: A.Shape, compare, keep_first: bool, group: int, group_rows: int) -> DataFrame:
    """documents of keyed() -> (doc, th, low, high): positions in repeated windows, as runs that may overlap."""
    found = staged(A.repeated(staged(A.anchor_rows(documents, shape), "anchors")), "repeated-anchors")
    classes = staged(A.context_classes(found), "anchor-classes")
    several = staged(classes.join(A.class_counts(classes), "gram"), "anchor-representatives")
    size = several.agg(F.count("*").alias("rows"), F.max("classes").alias("most")).first()
    result = A.member_intervals(found, classes, shape, keep_first)
    groups = parts_for(size["rows"], group_rows)
    contexts = A.with_contexts(documents, several.where(F.col("classes") <= group), shape)
    contexts = contexts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    result = result.unionByName(contexts.groupBy("part").applyInArrow(compare, "doc long, th long, low int, high int"))
    if (size["most"] or 0) > group:
        windows = staged(A.windows_of(A.with_contexts(documents, several.where(F.col("classes") > group), shape), shape), "windows")
        result = result.unionByName(A.window_intervals(windows, shape, keep_first))
    return result


def suffix_dedup(docs: DataFrame, width: int = 200, gram: int = GRAM, group: int = GROUP, shallow: int = 64) -> DataFrame:
    """docs (doc_id, text, ...) -> row for row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are UTF-8 bytes; null and empty ones have none.  A byte goes if some string of
    width bytes covers it that also starts anywhere else, in the same text too, in the
    input as it is.  kept is the rest (binary: a cut may fall inside a character).
    Rows that share a doc_id, or have none, are texts of their own, and repeated rows
    repeat each other.  Other columns are not read.  No rows give no rows.
    """
    shape = A.Shape(width, gram, words=False)
    documents = A.keyed(docs)
    runs = staged(A.per_document(repeat_intervals(documents, shape, _compare(width, shallow), False, group, GROUP_ROWS), "low", "high"), "repeat-runs")

    def cut(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                low, high = A.merged(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), len(data))
                edges = np.concatenate([[0], np.stack([low, high], 1).ravel(), [len(data)]]).tolist()
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(low) else data
                out.append((len(data), len(data) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = documents.join(runs, ["doc", "th"], "left").select("doc", "text", "low", "high")
    result = joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result.select(F.when(F.col("doc") != A.NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def suffix_sql(width: int = 200) -> str:
    """DuckDB's SQL over all strings of width bytes, in hexadecimal, for tables whose doc_ids are distinct and not null."""
    return f"""
WITH bytes AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {width} + 1)) AS i FROM bytes WHERE length(h) // 2 >= {width}),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * width})) AS t FROM places),
often AS (SELECT t FROM strings GROUP BY t HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM strings SEMI JOIN often USING (t)),
runs AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > {width} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, run, min(i) AS low, max(i) + {width} AS high FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans),
pieces AS (SELECT doc_id, count(*) AS n_spans, sum(high - low) AS removed, max(high) AS last,
  string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS text FROM edges JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(p.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(p.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(p.text, '') || substr(b.h, 2 * coalesce(p.last, 0) + 1))) AS kept_sha256
FROM bytes b LEFT JOIN pieces p ON p.doc_id = b.doc_id
"""
