"""Benchmark decontamination: item-sized windows of documents, by SimHash.

A document leaks an item if some window of as many words as the item has agrees with
it to a weighted-shingle similarity of 0.8: shingles are five words (all words of a
shorter item), weighted by how often they occur, and the similarity is the sum of
the lesser weights over the sum of the greater ones.

Every document is covered by windows: items are put into classes of like size, and for each
class windows of its size are laid at every seventh of it, a SimHash for each from running
sums of the shingles' bits.  An index over four blocks of 16 bits finds every item of the class
within the radius: of two fingerprints within 4 d + 3 bits, some block differs by d or fewer.
Items found are verified exactly, at every place around the window.

The radius is 15 of 64 bits.  A copy whose window lies askew by half a step and is off by half a
class differs in about 8 bits, with a deviation of 2.7; one at the least similarity in about 11.

Items are read in blocks of a fixed number, each sent to all tasks; documents stay where
they are, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Ranges, words_in
from .shared import packed, parts_for, row_columns, staged, text_or_empty

WIDTH = 5
SIMILARITY = 0.8
#: Bits by which fingerprints may differ.
RADIUS = 15
#: Ratio of the greatest to the least size in a class, and steps of windows in a window's size.
CLASS_RATIO, STEPS = 1.16, 7
BLOCK_ITEMS = 1000
#: Shingles whose bits are summed at once.
STRETCH = 50_000
_ASCII = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain_bytes(text: str) -> bytes:
    """Lower case, with all ASCII characters but letters and digits as blanks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII)


#: The bits of each byte as eight counters of 16 bits, which are summed as two whole numbers.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16).view(np.uint64)


def _running(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the bits of hashes, a row more than these."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 1 << 16:
        sums = np.zeros((len(hashes) + 1, 16), np.uint64)
        np.cumsum(_COUNTERS[octets].reshape(-1, 16), axis=0, out=sums[1:])
        return sums
    sums = np.zeros((len(hashes) + 1, 64), np.uint32)
    np.cumsum(np.unpackbits(octets, axis=1), axis=0, dtype=np.uint32, out=sums[1:])
    return sums


def window_prints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of each range of shingles: bits set in more than half of them, repeats included."""
    # Counters never fall along the sums, so differences of counters do not borrow from one another.
    ones = sums[end] - sums[start]
    ones = ones.view(np.uint16) if ones.dtype == np.uint64 else ones
    return np.packbits(ones > ((end - start) // 2).astype(ones.dtype)[:, None], axis=1).view(np.uint64).ravel()


def simhash(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, repeats included."""
    return int(window_prints(_running(hashes), np.array([0]), np.array([len(hashes)]))[0])


def weights(hashes: np.ndarray) -> dict[int, int]:
    values, counts = np.unique(hashes, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    shared = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 0.0


def _flips(most: int) -> np.ndarray:
    """All 16-bit patterns of at most so many ones."""
    values = np.arange(1 << 16, dtype=np.uint16)
    return values[np.bitwise_count(values) <= most]


class Blocks:
    """Index of at most 64 fingerprints: for each value of each block of 16 bits, the fingerprints near it there."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = _flips(radius // 4)
        self.near = np.zeros((4, 1 << 16), np.uint64)
        for block in range(4):
            values = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
            for k, v in enumerate(values):
                self.near[block, v ^ flips] |= np.uint64(1 << k)

    def returned(self, fps: np.ndarray) -> np.ndarray:
        """Fingerprints of the index that some block returns for each of fps, as the bits of a number."""
        found = np.zeros(len(fps), np.uint64)
        for block in range(4):
            found |= self.near[block][((fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)]
        return found

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in fps, number in the index) within the radius."""
        found = self.returned(fps)
        at, number = [], []
        some = np.flatnonzero(found)
        for k, own in enumerate(self.prints):
            maybe = some[(found[some] >> np.uint64(k)) & np.uint64(1) == 1]
            maybe = maybe[np.bitwise_count(fps[maybe] ^ own) <= self.radius]
            at.append(maybe), number.append(np.full(len(maybe), k))
        return np.concatenate(at), np.concatenate(number)


class Index:
    """Items of one block: their shingles, and the index of their fingerprints, class by class."""

    def __init__(self, ids: list, texts: list[str], radius: int):
        self.ids, self.sizes, self.weights = [], [], []
        kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, text in zip(ids, texts, strict=True):
            values, _ = words_in(plain_bytes(text))
            if not len(values):
                continue
            width = min(WIDTH, len(values))
            shingles = Ranges(values).grams(width)
            kind = int(np.log(len(shingles)) / np.log(CLASS_RATIO))
            kinds.setdefault((width, kind), []).append((len(self.ids), simhash(shingles)))
            self.ids.append(item), self.sizes.append(len(shingles)), self.weights.append(weights(shingles))
        #: (width, size of the windows, items, index) of each class, 64 items at most.
        self.classes = []
        for (width, _), own in sorted(kinds.items()):
            for low in range(0, len(own), 64):
                numbers, prints = zip(*own[low : low + 64], strict=True)
                sizes = [self.sizes[n] for n in numbers]
                size = int(round((min(sizes) * max(sizes)) ** 0.5))
                self.classes.append((width, size, np.array(numbers), Blocks(np.array(prints, np.uint64), radius)))

    def best(self, grams: np.ndarray, item: int, low: int, high: int) -> float:
        """Best similarity of the item to its windows that start in low..high of a document's shingles."""
        own, size = self.weights[item], self.sizes[item]
        span = min(size, len(grams))
        low, high = max(0, min(low, len(grams) - span)), min(high, len(grams) - span)
        near = grams[low : high + span].tolist()
        counts: dict[int, int] = {}
        shared, best = 0, 0
        for k, h in enumerate(near):
            if h in own:
                shared += counts.get(h, 0) < own[h]
                counts[h] = counts.get(h, 0) + 1
            if k >= span and (gone := near[k - span]) in own:
                counts[gone] -= 1
                shared -= counts[gone] < own[gone]
            if k >= span - 1:
                best = max(best, shared)
        return best / (size + span - best)


def _windows(first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of size shingles in each run first..last, the last one at its end; a shorter run is one window."""
    step = max(1, size // STEPS)
    room = np.maximum(last - first - size, 0)
    times = -(-room // step) + 1
    which = np.repeat(np.arange(len(first)), times)
    place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    start = first[which] + np.minimum(place * step, room[which])
    return start, np.minimum(start + size, last[which])


def _scan(texts: list[str], index: Index, least: float):
    """What each text leaks, with the best similarity of each item."""
    found: list[dict] = [{} for _ in texts]
    if not index.ids:
        return found
    data = [plain_bytes(t) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    values, starts = words_in(b" ".join(data))
    doc = np.searchsorted(ends, starts, "right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for width in sorted({c[0] for c in index.classes}):
        classes = [c for c in index.classes if c[0] == width]
        if len(values) < width:
            continue
        grams = Ranges(values).grams(width)
        low, high = first[:-1], np.maximum(first[1:] - width + 1, first[:-1])
        # A stretch of shingles at a time, with as many more as the widest window has.
        widest = max(size for _, size, _, _ in classes)
        for begin in range(0, len(grams), STRETCH):
            stop = min(len(grams), begin + STRETCH + widest)
            sums = _running(grams[begin:stop])
            own = np.flatnonzero((high > begin) & (low < stop) & (high > low))
            a, b = np.maximum(low[own], begin), np.minimum(high[own], stop)
            for _, size, numbers, blocks in classes:
                # Texts far shorter than the items of a class cannot be like them.
                fit = np.flatnonzero(b - a >= least * size / CLASS_RATIO)
                if not len(fit):
                    continue
                start, end = _windows(a[fit], b[fit], size)
                at, k = blocks.within(window_prints(sums, start - begin, end - begin))
                hits: dict[tuple[int, int], list[int]] = {}
                owner = np.searchsorted(first, start[at], "right") - 1
                for d, item, s in zip(owner.tolist(), numbers[k].tolist(), start[at].tolist(), strict=True):
                    hits.setdefault((d, item), []).append(s - int(first[d]))
                for (d, item), places in hits.items():
                    slack = index.sizes[item] // 4 + abs(index.sizes[item] - size) + 1
                    places = sorted(places)
                    runs = [[places[0], places[0]]]
                    for s in places[1:]:
                        if s - runs[-1][1] <= 2 * slack:
                            runs[-1][1] = s
                        else:
                            runs.append([s, s])
                    s = max(index.best(grams[low[d] : high[d]], item, x - slack, y + slack) for x, y in runs)
                    if s >= least - 1e-9 and s > found[d].get(index.ids[item], 0.0):
                        found[d][index.ids[item]] = s
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK_ITEMS
) -> DataFrame:
    """docs (text, ...) -> row for row: row (all columns of docs, as a struct), n_items, best_item, best_similarity.

    n_items: benchmark rows (item_id, text) that the text leaks; 0 for null and empty
    texts, and best_item and best_similarity are then null.  Ties in similarity go to the
    smaller item_id.  Items that are null, or have no letters or digits, leak nowhere;
    items with a null item_id are left out; repeated items count once each by item_id.
    No documents give no rows; an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), "text").count()
    items = staged(items.select("item_id", "text"), "benchmark-items")
    blocks = parts_for(items.count(), max(1, block // 2))
    state = packed(docs, text_or_empty().alias("text"), F.lit(0).cast("long").alias("n_items"),
                   F.lit(None).cast("long").alias("best_item"), F.lit(None).cast("double").alias("best_similarity"))
    schema = state.schema
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).orderBy("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast((part.column(0).to_pylist(), part.column(1).to_pylist()))

        def run(batches, sent=sent):
            index = Index(*sent.value, radius)
            for batch in batches:
                for low in range(0, batch.num_rows, 200):
                    piece = batch.slice(low, 200)
                    texts = piece.column(1).to_pylist()
                    counts, items_, best = (piece.column(k).to_pylist() for k in (2, 3, 4))
                    for k, leak in enumerate(_scan(texts, index, least)):
                        counts[k] += len(leak)
                        for item, s in leak.items():
                            if best[k] is None or (s, -item) > (best[k], -items_[k]):
                                items_[k], best[k] = item, s
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), piece.column(1), pa.array(counts, pa.int64()), pa.array(items_, pa.int64()), pa.array(best, pa.float64())],
                        schema=piece.schema,
                    )

        state = state.mapInArrow(run, schema)
    return state.drop("text")


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs -> doc_id, contaminated, n_items, best_item, best_similarity, row for row."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_similarity"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that leak no item, with the columns of docs."""
    return contamination(docs, benchmark, **options).where("n_items = 0").select(row_columns(docs))
