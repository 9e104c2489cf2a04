"""Repeated windows of tokens: which places of a corpus can hold one, and in what company.

A window is ``width`` consecutive tokens of one document (bytes, or words).  To find
the windows that occur more than once without moving every suffix of the corpus, each
window is filed under its anchor: of the ``gram``-token pieces in it, the one whose hash
is least.  Equal windows have equal anchors at equal places, so a window can only
repeat where its anchor does, and about one position in width / 2 is an anchor.  All
of that is lossless; what a repeated anchor's surroundings have in common is left to
the operators, which sort the suffixes there.

Steps, each an aggregation or equi join with map-side combine.  Hot anchors are joined where
they lie: a key with more than a HOT-th of all rows is one of at most HOT such keys, so these can be
broadcast at any size of the corpus.

1. ``anchor_rows``: anchors of each text with a hash of their context, that is, all
   tokens of windows filed under it.
2. ``repeated``: only anchors whose piece occurs twice or more.
3. ``context_classes``: anchors with the same context are one class with one representative.
   Every window in a class of two or more repeats, so nothing is left to compare there.
4. ``with_contexts``: the tokens of representatives of pieces that have several classes.

A row's key is (doc, th): its doc_id, and a hash of doc_id and text, so that several
rows may share a doc_id or have none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

#: Tokens that are hashed at once; longer texts are taken in overlapping pieces.
CHUNK = 1 << 20
#: A key is hot if it has more than one in so many of all rows, so there are at most so many hot keys.
HOT = 2000
#: Stands for a missing doc_id in keys.
NO_ID = -(2**63)
#: An odd factor, and its inverse modulo 2 ** 64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256).astype(np.uint64)


@dataclass(frozen=True)
class Shape:
    """Windows of width tokens, filed under pieces of gram tokens; tokens are bytes or words."""

    width: int
    gram: int
    words: bool

    @property
    def left(self) -> int:
        """Tokens before an anchor that windows filed under it can have."""
        return self.width - self.gram


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 4096)
            cls.up, cls.down = cls._made(n, _FACTOR), cls._made(n, _INVERSE)
        return cls.up[:n], cls.down[:n]


    @staticmethod
    def _made(n: int, factor: int) -> np.ndarray:
        factors = np.full(n, factor, np.uint64)
        factors[0] = 1
        return factors.cumprod(dtype=np.uint64)


class Ranges:
    """Hashes of any range of a token sequence, from sums of powers."""

    def __init__(self, tokens: np.ndarray):
        up, _ = _Powers.of(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _Powers.of(len(self.sums))
        return (self.sums[end] - self.sums[start]) * down[start]

    def grams(self, g: int) -> np.ndarray:
        _, down = _Powers.of(len(self.sums))
        n = len(self.sums) - g
        return mixed((self.sums[g:] - self.sums[:n]) * down[:n])


def word_values(data: bytes) -> np.ndarray:
    return words_in(data)[0]


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of data, of one polynomial over its bytes and its length, and where each word starts."""
    octets = np.frombuffer(data, np.uint8)
    blank = (octets == 32) | ((octets >= 9) & (octets <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    values = []
    first = 0
    while first < len(starts):  # a stretch of bytes at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        base = int(starts[first])
        part = Ranges(_BYTE_VALUES[octets[base : int(ends[last - 1])]])
        values.append(mixed(part.raw(starts[first:last] - base, ends[first:last] - base)) ^ (ends - starts)[first:last].astype(np.uint64))
        first = last
    return mixed(np.concatenate(values)), starts


def token_values(text: str, shape: Shape) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    return word_values(data) if shape.words else _BYTE_VALUES[np.frombuffer(data, np.uint8)]


def _sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    done = 1
    while done * 2 <= span:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (span - done)], values[span - done :]) if span > done else values


_TOP = np.uint32(0xFFFFFFFF)


def find_anchors(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape):
    """Anchors in the pieces [starts, ends) of tokens: positions, gram hashes, context hashes, numbers of pieces."""
    nothing = np.zeros(0, np.int64)
    if len(tokens) < shape.width:
        return nothing, nothing.astype(np.uint64), nothing.astype(np.uint64), nothing
    ranges, n = Ranges(tokens), len(tokens)
    grams = ranges.grams(shape.gram)
    piece = np.repeat(np.arange(len(starts)), ends - starts)
    room = ends[piece] - np.arange(n)
    rank = np.where(room[: len(grams)] >= shape.gram, (grams >> np.uint64(33)).astype(np.uint32) + np.uint32(1), _TOP)
    span = shape.left + 1
    least = _sliding(rank, span, np.minimum)
    least = np.where(room[: len(least)] >= shape.width, least, np.uint32(0))
    edge = np.zeros(span - 1, np.uint32)
    most = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    at = np.flatnonzero(most == rank)
    low = np.maximum(at - shape.left, starts[piece[at]])
    high = np.minimum(at + shape.width, ends[piece[at]])
    lengths = ((at - low) * 4096 + (high - at)).astype(np.uint64)
    context = mixed(mixed(ranges.raw(low, high)) + lengths)
    return at, grams[at], context, piece[at]


def _pieces(length: int, margin: int):
    """(first, last, low, high): tokens first..last are looked at, anchors in low..high are kept."""
    for low in range(0, max(length, 1), CHUNK):
        high = min(length, low + CHUNK)
        yield max(0, low - margin), min(length, high + margin), low, high


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc, th, text)."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64(doc_id, text_or_empty()).alias("th"), text_or_empty().alias("text")
    )


_ANCHORS = "gram long, ctx long, doc long, th long, pos int"


def anchor_rows(documents: DataFrame, shape: Shape) -> DataFrame:
    """documents of keyed() -> anchors (gram, ctx, doc, th, pos)."""

    def run(batches):
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            waiting, size = [], 0
            for row in range(batch.num_rows):
                values = token_values(batch.column(2)[row].as_py(), shape)
                if len(values) < shape.width:
                    continue
                for first, last, low, high in _pieces(len(values), 2 * shape.width):
                    waiting.append((row, first, low, high, values[first:last]))
                    size += last - first
                    if size >= CHUNK // 2:
                        yield flush(waiting, doc, th)
                        waiting, size = [], 0
            if waiting:
                yield flush(waiting, doc, th)

    def flush(waiting, doc, th):
        rows, firsts, lows, highs = (np.array(x) for x in list(zip(*waiting, strict=True))[:4])
        lengths = np.array([len(w[4]) for w in waiting])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        at, gram, ctx, piece = find_anchors(np.concatenate([w[4] for w in waiting]), starts, ends, shape)
        pos = at - starts[piece] + firsts[piece]
        own = (pos >= lows[piece]) & (pos < highs[piece])
        row = rows[piece[own]]
        arrays = [gram[own].view(np.int64), ctx[own].view(np.int64), doc[row], th[row], pos[own].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "ctx", "doc", "th", "pos"])

    return documents.mapInArrow(run, _ANCHORS)


def repeated(anchors: DataFrame) -> DataFrame:
    """Anchors whose piece occurs at two places or more; anchors are staged."""
    total = anchors.count()
    # Written first, so that the join is one of two plain exchanges, whose skewed parts Spark splits.
    often = staged(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    hot = F.broadcast(often.where(F.col("n") * HOT > total).select("gram"))
    others = anchors.join(hot, "gram", "left_anti").join(often.where(F.col("n") * HOT <= total).select("gram"), "gram", "left_semi")
    return anchors.join(hot, "gram", "left_semi").unionByName(others)


def context_classes(anchors: DataFrame) -> DataFrame:
    """(gram, ctx, members, doc, th, pos): a row per context, with its first place."""
    first = F.min(F.struct("doc", "th", "pos")).alias("first")
    return anchors.groupBy("gram", "ctx").agg(F.count("*").alias("members"), first).select("gram", "ctx", "members", "first.*")


def class_counts(classes: DataFrame) -> DataFrame:
    """(gram, classes) of the pieces with several classes."""
    return classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")


def member_intervals(anchors: DataFrame, classes: DataFrame, shape: Shape, keep_first: bool) -> DataFrame:
    """(doc, th, low, high): contexts of the members of classes of two or more, but for the first if keep_first.

    high may lie beyond the end of the text, low before its start; callers clip.
    """
    total = anchors.count()
    own = classes.where("members > 1").select("gram", "ctx", "members", F.col("doc").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"))
    is_hot = F.col("members") * HOT > total
    hot, cold = F.broadcast(own.where(is_hot).drop("members")), own.where(~is_hot).drop("members")
    others = anchors.join(hot.select("gram", "ctx"), ["gram", "ctx"], "left_anti").join(cold, ["gram", "ctx"])
    joined = anchors.join(hot, ["gram", "ctx"]).select(others.columns).unionByName(others)
    if keep_first:
        joined = joined.where("not (doc = d and th = t and pos = p)")
    return joined.select("doc", "th", (F.col("pos") - shape.left).alias("low"), (F.col("pos") + shape.width).alias("high"))


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of each (doc, th), as parallel arrays; their number is bounded by the text's length, however often it is repeated."""
    return rows.groupBy("doc", "th").agg(F.collect_set(F.struct(*columns)).alias("own")).select(
        "doc", "th", *[F.col(f"own.{c}").alias(c) for c in columns]
    )


_CONTEXTS = "gram long, members long, doc long, th long, pos int, before binary, after binary"


def with_contexts(documents: DataFrame, representatives: DataFrame, shape: Shape) -> DataFrame:
    """representatives (gram, members, doc, th, pos) -> the same with the tokens before and from the anchor on.

    Bytes as they are; words as 8-byte hashes.
    """
    wanted = per_document(representatives, "gram", "members", "pos")
    size = 8 if shape.words else 1

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc, th, text, grams, members, places = (c[row].as_py() for c in batch.columns)
                data = text.encode("utf-8", "surrogatepass")
                data = word_values(data).tobytes() if shape.words else data
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams, pa.int64()), pa.array(members, pa.int64()), pa.array([doc] * n, pa.int64()),
                        pa.array([th] * n, pa.int64()), pa.array(places, pa.int32()),
                        pa.array([data[max(0, p - shape.left) * size : p * size] for p in places], pa.binary()),
                        pa.array([data[p * size : (p + shape.width) * size] for p in places], pa.binary()),
                    ],
                    ["gram", "members", "doc", "th", "pos", "before", "after"],
                )

    # Rows with one key have one text, and are read once.
    joined = documents.join(wanted, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("doc", "th", "text", "gram", "members", "pos")
    return joined.mapInArrow(run, _CONTEXTS)


def windows_of(contexts: DataFrame, shape: Shape) -> DataFrame:
    """contexts -> every window filed under them: (w1, w2, members, doc, th, start), named by two hashes.

    The exact way for pieces with more classes than one task should hold.
    """
    size = 8 if shape.words else 1

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                gram, members, doc, th, pos, before, after = (c[row].as_py() for c in batch.columns)
                data = before + after
                tokens = np.frombuffer(data, np.uint64) if shape.words else _BYTE_VALUES[np.frombuffer(data, np.uint8)]
                begin = np.arange(min(len(before) // size, shape.left) + 1)
                begin = begin[begin + shape.width <= len(tokens)]
                if not len(begin):
                    continue
                n = len(begin)
                first = mixed(Ranges(tokens).raw(begin, begin + shape.width))
                second = mixed(Ranges(mixed(tokens)).raw(begin, begin + shape.width))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array([members] * n, pa.int64()),
                        pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()),
                        pa.array((begin + pos - len(before) // size).astype(np.int32)),
                    ],
                    ["w1", "w2", "members", "doc", "th", "start"],
                )

    contexts = contexts.dropDuplicates(["gram", "doc", "th", "pos"])
    return contexts.mapInArrow(run, "w1 long, w2 long, members long, doc long, th long, start int")


def window_intervals(windows: DataFrame, shape: Shape, keep_first: bool) -> DataFrame:
    """(doc, th, low, high) of windows that repeat, but for the first of each if keep_first."""
    # A window lies in the contexts of several anchors, and is one place.
    places = windows.groupBy("w1", "w2", "doc", "th", "start").agg(F.max("members").alias("members"))
    counted = places.groupBy("w1", "w2").agg(
        F.count("*").alias("places"), F.max("members").alias("members"), F.min(F.struct("doc", "th", "start")).alias("first")
    )
    counted = counted.where("places > 1 or members > 1").select("w1", "w2", F.col("first.doc").alias("d"), F.col("first.th").alias("t"), F.col("first.start").alias("p"))
    joined = windows.join(counted, ["w1", "w2"])
    if keep_first:
        joined = joined.where("not (doc = d and th = t and start = p)")
    return joined.select("doc", "th", F.col("start").alias("low"), (F.col("start") + shape.width).alias("high"))


def merged(low: list[int], high: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same positions of 0..length; runs that touch are one."""
    if low is None or len(low) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.clip(np.array(low), 0, length), np.clip(np.array(high), 0, length)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    starts = np.flatnonzero(new)
    return low[starts], high[np.concatenate([starts[1:] - 1, [len(low) - 1]])]
