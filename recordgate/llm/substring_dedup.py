"""Substring dedup: words covered by a window of 20 that also starts earlier.

Suffixes of the word sequences are split by prefixes of variable length: the words
of an anchor (anchors.py), and for anchors with more suffixes than a task should hold,
all words of the window.  Each group's suffixes form one suffix tree, kept as its leaves
in order with the depth at which each parts from the one before: an inner node is a stretch of
leaves whose depths do not fall below its own.  Nodes of depth 20 and more are repeats, and a
leaf that is not the earliest of its deepest such node repeats as many words as the node is deep.

Places with equal surroundings are one leaf (they are told by a hash of all words around them), and
all of them but the first repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .shared import staged
from .suffix_dedup import GROUP, _sorted_groups, repeat_intervals

GRAM = 6
GROUP_ROWS = 8_000


def _suffixes(befores: pa.ChunkedArray, afters: pa.ChunkedArray, rows: np.ndarray, shape: A.Shape):
    """Matrix of the words around each anchor, zero where there are none, and how many stand before and after."""
    left, width = shape.left, shape.width
    words = np.zeros((len(rows), left + width), np.uint64)
    before, after = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    befores, afters = befores.to_pylist(), afters.to_pylist()
    for k, r in enumerate(rows.tolist()):
        b, a = np.frombuffer(befores[r], np.uint64), np.frombuffer(afters[r], np.uint64)
        words[k, left - len(b) : left], words[k, left : left + len(a)] = b, a
        before[k], after[k] = len(b), len(a)
    return words, before, after


def tree_depths(suffixes: np.ndarray, length: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix tree of the rows under each prefix: leaves in order, and the depth at which each parts from the one before.

    A row has length words, and what is beyond these does not count.
    """
    order = np.lexsort((*suffixes.T[::-1], prefix))
    rows, kept, length = suffixes[order], prefix[order], length[order]
    if not len(rows):
        return order, np.zeros(0, np.int64)
    same = rows[1:] == rows[:-1]
    depth = np.where(same.all(1), rows.shape[1], same.argmin(1))
    depth = np.minimum(depth, np.minimum(length[1:], length[:-1]))
    depth[kept[1:] != kept[:-1]] = 0
    return order, np.concatenate([[0], depth])


def repeated_depths(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """For each row the depth of the deepest node of at least that depth in which it is not the earliest row; 0 if there is none."""
    found = np.zeros(len(order), np.int64)
    for level in range(int(depth.max(initial=0)), least - 1, -1):
        node = np.cumsum(depth < level)
        earliest = np.full(node[-1] + 1, len(order), np.int64)
        np.minimum.at(earliest, node, order)
        later = order[(order != earliest[node]) & (found[order] == 0)]
        found[later] = level
    return found


def _compare(shape: A.Shape):
    def compare(table: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        doc, th, low, high = empty, empty, empty.astype(np.int32), empty.astype(np.int32)
        if table.num_rows:
            rows, starts, ends = _sorted_groups(table)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            docs, ths, pos = (table.column(c).to_numpy()[rows] for c in ("doc", "th", "pos"))
            words, before, after = _suffixes(table.column("before"), table.column("after"), rows, shape)
            left, width = shape.left, shape.width
            first, last = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
            for step in range(left + 1):  # suffixes that start step words before their anchor
                own = np.flatnonzero((before >= step) & (after >= width - step))
                if not len(own):
                    continue
                # Rows stand in order of (doc, th, pos) within their group, so the least row of a node is its earliest.
                order, depth = tree_depths(words[own, left - step :], step + after[own], group[own])
                deep = repeated_depths(order, depth, width)
                later, end = own[deep > 0], deep[deep > 0] - step
                first[later] = np.maximum(first[later], end)
                last[later] = step
            hit = np.flatnonzero(last >= 0)
            doc, th = docs[hit], ths[hit]
            low, high = (pos[hit] - last[hit]).astype(np.int32), (pos[hit] + first[hit]).astype(np.int32)
        return pa.table({"doc": pa.array(doc), "th": pa.array(th), "low": pa.array(low), "high": pa.array(high)})

    return compare


def substring_dedup(docs: DataFrame, width: int = 20, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """docs (doc_id, text, ...) -> row for row: doc_id, n_words, n_removed, kept_sha256, kept.

    Words are runs of characters other than ASCII white space, unchanged; null and empty
    texts have none.  A word goes if a window of width words covers it whose words also
    start earlier: at a smaller doc_id, or earlier in the same text; windows are judged on
    the input as it is.  kept is the remaining words, joined by one space.  Null doc_ids come first.
    Rows that share a doc_id but not a text come in the order of a hash; rows
    alike in both are one place, and all keep what it keeps.  Other columns are
    not read.  No rows give no rows.
    """
    shape = A.Shape(width, gram, words=True)
    documents = A.keyed(docs)
    runs = staged(A.per_document(repeat_intervals(documents, shape, _compare(shape), True, group, GROUP_ROWS), "low", "high"), "repeat-runs")

    def cut(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                words = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass").split()
                low, high = A.merged(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), len(words))
                rest = words
                if len(low):
                    edges = np.concatenate([[0], np.stack([low, high], 1).ravel(), [len(words)]]).tolist()
                    rest = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                kept = b" ".join(rest)
                out.append((len(words), len(words) - len(rest), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                ["doc", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    joined = documents.join(runs, ["doc", "th"], "left").select("doc", "text", "low", "high")
    result = joined.mapInArrow(cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return result.select(F.when(F.col("doc") != A.NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def substring_sql(width: int = 20) -> str:
    """DuckDB's SQL over all windows, for tables whose doc_ids are distinct and not null."""
    return f"""
WITH split AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM split WHERE len(w) >= {width}),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {width} - 1], ' ')) AS t FROM places),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS p FROM ranked WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON kept.doc_id = split.doc_id
"""
