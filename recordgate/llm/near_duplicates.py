"""Near duplicates of whole documents: SimHash tiles dealt by rare shingles, then exact verification.

Two texts are near duplicates if their sets of five-word shingles have a similarity of 0.8 or
more.  A radius of many bits leaves no blocks of a fingerprint that would tell unrelated
texts apart, so tiles are not dealt by bits here but by shingles: in an order common to all
texts, rare shingles first, two sets of that similarity share one of the first fifth of each
(the prefixes), so every such pair meets in the tile of the first shingle they share.  There each has
only the shingles after it left to share, which rules out most texts that are merely akin.  In a
tile, fingerprints are compared exactly, by exclusive-or and bit counts of whole blocks; pairs within
the radius whose sizes and rests allow the similarity are candidates, and these are verified on the whole sets.

A text has one candidate at first: of the texts that come first among its likes in each of its
tiles, the one it meets most often.  In a tile of few texts all are compared for that, in a larger
one, as of near copies, each with a few pivots, the same for the whole tile.  What these candidates
connect is a family.  Sets of a family meet block by block and are compared there, and each pair of
blocks gives a forest of its links, never all pairs.  Last, the texts of the tiles are compared again,
but only across families, so no pair is left out.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import CHUNK, NO_ID, Ranges, mixed, words_in
from .components import components
from .shared import key_filter, packed, parts_for, row_columns, staged, staged_alone, text_or_empty
from .simhash_dedup import _Forest, _majority

#: Words of a shingle, least similarity, and the bits by which fingerprints of such texts may differ: at a similarity
#: of 0.8 about 10 of 64 do, and 24 is five deviations more.  Sets of fewer than FEW shingles are verified at any distance.
WORDS, SIMILARITY, RADIUS, FEW = 5, 0.8, 24, 16
#: Texts of a tile that are all compared with one another at first, and pivots of a larger tile.
SMALL, PIVOTS = 12, 48
#: Hot shingles come last in the order of prefixes: those of at least HOT_TEXTS texts in a sample of one text in SAMPLE,
#: at most HOT_LIST of them.  Any order loses nothing; this one keeps the tiles of a shingle small.
SAMPLE, HOT_TEXTS, HOT_LIST = 16, 4, 200_000
#: Texts of one tile of a hot shingle, and entries of prefixes in one Python group.
TILE, GROUP_ROWS = 16_384, 1_000_000
#: Texts of one block of a family, and texts of one Python group.
FAMILY_BLOCK, FAMILY_ROWS = 256, 2000
#: Characters of text that are hashed at once.
STEP = 1 << 20


def _grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width values in a row, a stretch at a time."""
    n = max(0, len(values) - width + 1)
    parts = [Ranges(values[low : min(low + CHUNK, n) + width - 1]).grams(width) for low in range(0, n, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str], width: int = WORDS) -> list[np.ndarray]:
    """Distinct shingles of each text as hashes, ascending.

    A-Z count as a-z; words are runs of characters other than ASCII white space.  A text of fewer words has its
    whole sequence as its one shingle, and texts without words are alike.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    values, starts = words_in(b"\n".join(parts))
    first = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)])).tolist()
    grams = _grams(values, width)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            sets.append(mixed(Ranges(values[a:b]).raw(np.array([0]), np.array([b - a])) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(1, np.uint64))
    return sets


def _stretches(texts: list[str]):
    """(low, high) of texts of about STEP characters in all."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= STEP or k + 1 == len(texts):
            yield low, k + 1
            low, size = k + 1, 0


def fingerprints_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: bits set in more than half of its shingles."""
    counts = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    for low in range(0, len(sets), 256):
        part = sets[low : low + 256]
        doc = np.repeat(np.arange(len(part)), counts[low : low + 256])
        out[low : low + 256] = _majority(np.concatenate(part), doc, len(part), counts[low : low + 256])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, ascending."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def prefix_of(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """First shingles of a text in an order common to all texts, so many that two texts of the similarity share one.

    Two sets of similarity least share at least ceil(least * n) of the n shingles of either, so of
    its first n - that + 1 at least one is shared, and the first shared one is among these in both.
    The order: shingles that are not hot by hash, then the hot ones by rank.
    """
    take = len(shingles) - ceil(least * len(shingles) - 1e-9) + 1
    if not len(hot):
        return shingles[:take]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    known = hot[at] == shingles
    cold = shingles[~known]
    if len(cold) >= take:
        return cold[:take]
    late = at[known]
    return np.concatenate([cold, hot[late[np.argsort(rank[late])]]])[:take]


def _hot_shingles(hashed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot shingles, ascending, the place of each in the order of prefixes, and about how many texts have it."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in _stretches(texts):
                own = np.concatenate(shingle_sets(texts[low:high], width))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["shingle"])

    sample = hashed.where(F.pmod("t1", F.lit(SAMPLE)) == 0).dropDuplicates(["t1", "t2"]).select("text")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= HOT_TEXTS)
    table = counts.orderBy(F.desc("count"), "shingle").limit(HOT_LIST).toArrow()
    hot, count = table.column("shingle").to_numpy().view(np.uint64), table.column("count").to_numpy()
    order = np.argsort(hot)
    hot, count = hot[order], count[order]
    rank = np.empty(len(hot), np.int64)
    rank[np.lexsort((hot, count))] = np.arange(len(hot))
    return hot, rank, count * SAMPLE


def _candidates(fp, size, rest, i, j, least: float, radius: int) -> np.ndarray:
    """Which pairs of rows lie within the radius, or are of few shingles, and have sizes and rests that allow the similarity.

    rest: the shingles of a text from the tile's on, in the order of prefixes.  If the tile's is the first that two texts
    share, they share no more than the lesser rest.
    """
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    near = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) | (small < FEW)
    return near & (small >= least * large - 1e-9) & (np.minimum(rest[i], rest[j]) >= least / (1 + least) * (size[i] + size[j]) - 1e-6)


def _hopeful(size: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Rows of a tile whose rest would do for the smallest text of the tile that their size allows."""
    sizes = np.sort(size)
    smallest = sizes[np.minimum(np.searchsorted(sizes, least * size - 1e-9), len(sizes) - 1)]
    return rest >= least / (1 + least) * (size + smallest) - 1e-6


def tiles_met(key, node, size, fp, rest, least: float, radius: int):
    """(text, first of its likes, tiles) of the tiles, and the rows that have likes or may have them.

    Rows of one key are a tile; a row that is there twice counts once.  In a tile of more than SMALL texts
    only the PIVOTS texts of least hash are looked at as first ones, and all rows may have likes.
    """
    order = np.lexsort((mixed(node), key))
    again = (key[order][1:] == key[order][:-1]) & (node[order][1:] == node[order][:-1])
    order = order[np.r_[True, ~again]] if len(order) else order
    key, node, size, fp, rest = key[order], node[order], size[order], fp[order], rest[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(key)])
    # Rows of larger tiles that can have no partner go first.
    keep = np.ones(len(key), bool)
    for s, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
        keep[s : s + n] = _hopeful(size[s : s + n], rest[s : s + n], least)
    key, node, size, fp, rest = (c[keep] for c in (key, node, size, fp, rest))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + lengths, lengths)
    many = np.repeat(lengths > SMALL, lengths)
    firsts = [np.zeros((2, 0), np.int64)]
    left, step = np.flatnonzero(~many), 1
    while len(left):
        left = left[left + step < end[left]]
        good = _candidates(fp, size, rest, left, left + step, least, radius)
        firsts.append(np.stack([left[good] + step, left[good]]))
        step += 1
    text, first = np.concatenate(firsts, 1)
    alike = many.copy()
    alike[text], alike[first] = True, True
    order = np.lexsort((first, text))
    text, first = text[order], first[order]
    once = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    firsts = [np.stack([text[once], first[once]])]
    for s, n in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
        free = np.arange(s + 1, s + n)
        for pivot in range(s, min(s + PIVOTS, s + n)):
            free = free[free > pivot]
            good = _candidates(fp, size, rest, np.full(len(free), pivot), free, least, radius)
            firsts.append(np.stack([free[good], np.full(good.sum(), pivot)]))
            free = free[~good]
    text, first = np.concatenate(firsts, 1)
    pairs, tiles = np.unique(np.stack([node[text].view(np.int64), node[first].view(np.int64)], 1), axis=0, return_counts=True)
    return (pairs[:, 0], pairs[:, 1], tiles), (key[alike], node[alike], size[alike], fp[alike], rest[alike])


_MET = "a long, b long, tiles long, key long, size int, fp long, rest int"


def _met_rows(firsts, rows) -> pa.Table:
    """Rows of _MET: a text, a first of its likes and the tiles in which it is that; then rows of tiles, which have a key and no b."""
    names = ["a", "b", "tiles", "key", "size", "fp", "rest"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    key, node, size, fp, rest = rows
    parts = [
        dict(zip(("a", "b", "tiles"), firsts, strict=True)),
        {"a": node.view(np.int64), "key": key.astype(np.int64), "size": size, "fp": fp.view(np.int64), "rest": rest},
    ]
    return pa.concat_tables([pa.table([pa.array(p[n], k) if n in p else pa.nulls(len(p["a"]), k) for n, k in zip(names, kinds, strict=True)], names) for p in parts])


def first_candidates(texts: DataFrame, hot: np.ndarray, count: np.ndarray, groups: int, least: float, radius: int) -> DataFrame:
    """texts (node, size, fp, prefix) -> rows (a, b, tiles): a text and a first of its likes; (a, key, size, fp, rest): rows of tiles.

    A tile of a hot shingle is several, by a hash of the text, which all get its pivots.
    """
    large = hot[count > TILE]
    tiles = np.ceil(count[count > TILE] / TILE).astype(np.int64)
    known = texts.sparkSession.sparkContext.broadcast((large, tiles))

    def dealt(batches):
        large, tiles = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                part = batch.slice(low, 8192)
                own = [np.frombuffer(p, np.uint64) for p in part.column(3).to_pylist()]
                times = [len(p) for p in own]
                key, row = np.concatenate(own), np.repeat(np.arange(len(own)), times)
                rest = part.column(1).to_numpy()[row] - np.concatenate([np.arange(n, dtype=np.int32) for n in times])
                place = mixed(part.column(0).to_numpy().view(np.uint64))
                block = np.zeros(len(key), np.uint64)
                if len(large):
                    at = np.minimum(np.searchsorted(large, key), len(large) - 1)
                    split = np.flatnonzero(large[at] == key)
                    n = tiles[at[split]]
                    block[split] = place[row[split]] % n.astype(np.uint64)
                    # Twice the pivots that are needed, as the count is an estimate.
                    pivot = place[row[split]] / 2.0**64 * n * TILE < 2 * PIVOTS
                    more, n = split[pivot], n[pivot]
                    every = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
                    key, row, rest, block = (np.r_[c, x] for c, x in ((key, np.repeat(key[more], n)), (row, np.repeat(row[more], n)), (rest, np.repeat(rest[more], n)), (block, every)))
                to = (mixed(key + block * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((row, to))
                to, key, rest, row = to[order], (key[order] >> np.uint64(32)).astype(np.uint32), rest[order].astype(np.int32), row[order]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                # A text is sent once to a group, with the number of its keys there.
                head = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (row[1:] != row[:-1])])
                keys = np.diff(np.r_[head, len(to)]).astype(np.int32)
                first = np.searchsorted(head, starts)
                columns = [c.to_numpy()[row[head]] for c in (part.column(0), part.column(1), part.column(2))]
                cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True))
                heads = list(zip(first.tolist(), [*first[1:].tolist(), len(head)], strict=True))
                packs = [pa.array([c[s:e].tobytes() for s, e in cuts], pa.binary()) for c in (key, rest)]
                packs += [pa.array([c[s:e].tobytes() for s, e in heads], pa.binary()) for c in (keys, *columns)]
                yield pa.RecordBatch.from_arrays([pa.array(to[starts]), *packs], ["part", "key", "rest", "keys", "node", "size", "fp"])

    def meet(table: pa.Table) -> pa.Table:
        kinds = {"key": np.uint32, "rest": np.int32, "keys": np.int32, "node": np.uint64, "size": np.int32, "fp": np.uint64}
        key, rest, keys, node, size, fp = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in kinds.items())
        node, size, fp = (np.repeat(c, keys) for c in (node, size, fp))
        return _met_rows(*tiles_met(key, node, size, fp, rest, least, radius))

    sent = texts.select("node", "size", "fp", "prefix").mapInArrow(dealt, "part long, key binary, rest binary, keys binary, node binary, size binary, fp binary")
    return sent.groupBy("part").applyInArrow(meet, _MET)


def pairs_across(pair, side, root, size, fp, rest, least: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of different roots within tiles (rows of one pair and one side), or between both sides of a pair."""
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((ones, root, side, pair))
    pair, side, root, size, fp, rest, ones = (c[order] for c in (pair, side, root, size, fp, rest, ones))
    found = [np.zeros((2, 0), np.int64)]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]).tolist() if len(pair) else []
    for s, e in zip(starts, [*starts[1:], len(pair)], strict=True):
        cut = s + int(np.searchsorted(side[s:e], side[e - 1])) if side[s] != side[e - 1] else e
        low = s
        while low < cut:
            # Rows of one family, or of several small ones, against the rows after them or those of the other side.
            own_end = low + int(np.searchsorted(root[low:cut], root[low], "right"))
            high = min(cut, low + 256) if own_end < low + 256 else min(own_end, low + 256)
            begin = cut if cut < e else own_end
            for first in range(begin, e, 8192):
                last = min(e, first + 8192)
                few = size[low:high].min() < FEW or size[first:last].min() < FEW
                apart = max(ones[low:high].min() - ones[first:last].max(), ones[first:last].min() - ones[low:high].max())
                if apart > radius and not few:
                    continue
                near = np.bitwise_count(fp[low:high, None] ^ fp[None, first:last]) <= radius
                if few:
                    near |= np.minimum(size[low:high, None], size[None, first:last]) < FEW
                i, j = np.nonzero(near & (root[low:high, None] != root[None, first:last]))
                i, j = i + low, j + first
                good = (i < j) & _candidates(fp, size, rest, i, j, least, radius)
                found.append(np.stack([i[good], j[good]]))
            low = high
    pairs = np.concatenate(found, 1)
    return order[pairs[0]], order[pairs[1]]


def crossing_candidates(rows: DataFrame, families: DataFrame, least: float, radius: int, tile: int = TILE) -> DataFrame:
    """rows (key, node, size, fp, rest) of tiles, families (node, root) -> (a, b): candidates across families.

    Tiles of one family are left out.  A tile is dealt to pairs of blocks of tile rows, by a hash of the text.
    """
    own = rows.join(families, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = staged(own, "open-rows")
    sizes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.where("low <> high").select("key", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    sizes = staged(sizes, "open-tiles")
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    seats = own.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    seats = seats.select(pair.alias("pair"), (F.col("block") == F.col("other")).alias("same"), "block", "node", "root", "size", "fp", "rest")
    groups = parts_for(own.count(), GROUP_ROWS // 10)

    def cross(table: pa.Table) -> pa.Table:
        pair, node, root, size, fp, rest = (table.column(c).to_numpy() for c in ("pair", "node", "root", "size", "fp", "rest"))
        side = np.where(table.column("same").to_numpy(zero_copy_only=False), -1, table.column("block").to_numpy())
        a, b = pairs_across(pair, side, root, size, fp.view(np.uint64), rest, least, radius)
        pairs = np.unique(np.sort(np.stack([node[a], node[b]], 1), 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return seats.withColumn("part", F.pmod("pair", F.lit(groups))).groupBy("part").applyInArrow(cross, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs (a, b), sets (node, shingles) -> the pairs whose sets reach the similarity."""

    def run(batches):
        for batch in batches:
            one, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least - 1e-9 for x, y in zip(one, other, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    first = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    both = first.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(sets: list[np.ndarray], block: list[int], least: float) -> _Forest:
    """Forest of the texts whose shingle sets reach the similarity; texts of different blocks, or all if there is one."""
    forest = _Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    bounds = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    block = np.array(block)
    one = bool((block == block[0]).all())
    index = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[np.argsort(owner, kind="stable")]
    ends = np.cumsum(sizes)
    for i in range(len(sets)):
        # Shingles of text i, then whoever else has them.
        own = index[ends[i] - sizes[i] : ends[i]]
        reach = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        shared = np.bincount(owner[reach], minlength=len(sets))
        good = (shared >= least * (sizes + sizes[i] - shared) - 1e-9) & (np.arange(len(sets)) > i) & (shared > 0)
        if not one:
            good &= block != block[i]
        j = np.flatnonzero(good)
        forest.link(np.full(len(j), i), j)
    return forest


def with_blocks(families: DataFrame) -> DataFrame:
    """families (node, root) -> (node, root, blocks): in how many blocks of about FAMILY_BLOCK texts a family is cut."""
    sizes = staged(families.groupBy("root").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks")), "family-sizes")
    return families.join(sizes, "root").select("node", "root", "blocks")


def family_links(sets: DataFrame, least: float) -> DataFrame:
    """sets (node, root, blocks, shingles) -> (a, b): links within families, enough of them to connect what they connect.

    A family is cut into blocks by hash; each pair of blocks is one group.  Sets without a root are of no family.
    """
    seats = sets.where("root is not null").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    groups = parts_for(sets.agg(F.sum("blocks").alias("n")).first()["n"] or 0, FAMILY_ROWS)
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    seats = seats.select("node", pair.alias("pair"), "block", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        a, b = [], []
        if table.num_rows:
            order = np.argsort(table.column("pair").to_numpy(), kind="stable")
            pair, block, node = (table.column(c).to_numpy()[order] for c in ("pair", "block", "node"))
            shingles = table.column("shingles").to_pylist()
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=True):
                if e - s > 1:
                    root = _alike([np.frombuffer(shingles[k], np.uint32) for k in order[s:e].tolist()], block[s:e].tolist(), least).labels()
                    moved = np.flatnonzero(root != np.arange(e - s))
                    a.append(node[s + moved]), b.append(node[s + root[moved]])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return seats.withColumn("part", F.pmod("pair", F.lit(groups))).groupBy("part").applyInArrow(compare, "a long, b long")


def near_duplicate_groups(docs: DataFrame, least: float = SIMILARITY, width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text, ...) -> per distinct (doc_id, text): doc, t1, t2, rows, keeper, kept.

    Texts link when they are equal or their shingle sets have the similarity; groups are what
    links connect.  doc is doc_id, a missing one being ``NO_ID``; t1 and t2 are two hashes of the
    text, rows how many rows are alike in all.  keeper: the least doc_id of the group.  kept: true
    for one text of each group, the one with the least doc_id, then hashes.
    """
    doc_id, text = F.col("doc_id").cast("long"), text_or_empty()
    slim = docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    hashed = slim.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit("again")).alias("t2"))
    hot, rank, count = _hot_shingles(hashed, width)
    known = docs.sparkSession.sparkContext.broadcast((hot, rank))

    def prints(batches):
        hot, rank = known.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _stretches(texts):
                part = batch.slice(low, high - low)
                sets = shingle_sets(texts[low:high], width)
                fps = fingerprints_of_sets(sets).view(np.int64)
                own = pa.array([prefix_of(s, hot, rank, least).tobytes() for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), sizes, pa.array(fps), own], ["doc", "t1", "t2", "size", "fp", "prefix"])

    rows = staged(hashed.mapInArrow(prints, "doc long, t1 long, t2 long, size int, fp long, prefix binary"), "text-prints")
    named = F.xxhash64("t1", "t2")
    texts = rows.select("t1", "t2", named.alias("node"), "size", "fp", "prefix").dropDuplicates(["t1", "t2"])
    entries = rows.agg(F.sum(F.length("prefix")).alias("n")).first()["n"] or 0
    met = staged(first_candidates(texts, hot, count, parts_for(entries // 8, GROUP_ROWS), least, radius), "tiles-met")
    firsts = met.where("b is not null").groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))
    pairs = staged(firsts.groupBy("a").agg(F.max(F.struct("tiles", "b")).alias("most")).select("a", "most.b"), "candidates")
    open_rows = met.where("b is null").select("key", F.col("a").alias("node"), "size", "fp", "rest")
    families = staged(components(pairs), "families")
    across = staged(crossing_candidates(open_rows, families, least, radius), "candidates-across") if open_rows.limit(1).count() else None
    # Whole sets are asked for texts of families and of candidates across these, not for all that share a tile.
    nodes = with_blocks(families)
    if across is not None:
        asked = across.select(F.col("a").alias("node")).unionByName(across.select(F.col("b").alias("node"))).distinct()
        nodes = nodes.join(asked, "node", "full")
    # The text of a node is read from one of its rows, so that a text of many rows is no hot key.
    first = rows.groupBy("t1", "t2").agg(F.min("doc").alias("doc_id")).select("doc_id", named.alias("node"))
    nodes = staged(first.join(nodes, "node"), "candidate-texts")

    def sets_of(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for low, high in _stretches(texts):
                # 32 bits of each shingle are enough to tell those of two texts apart.
                own = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in shingle_sets(texts[low:high], width)], pa.binary())
                columns = [c.slice(low, high - low) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, own], ["node", "root", "blocks", "shingles"])

    # Most other texts are left out before the join, so that it doesn't shuffle them.
    row_name = F.xxhash64("doc_id", "node")
    wanted = hashed.select("doc_id", named.alias("node"), "text").where(key_filter(nodes.select(row_name.alias("name")), "name")(row_name))
    # A set takes its family with it, so that it is shuffled once more, to its blocks, and not to be joined before that.
    wanted = wanted.join(nodes, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("node", "root", "blocks", "text")
    sets = staged(wanted.mapInArrow(sets_of, "node long, root long, blocks int, shingles binary"), "shingle-sets")
    links = family_links(sets, least)
    if across is not None:
        links = links.unionByName(verified(across, sets.select("node", "shingles").where(key_filter(asked, "node")(F.col("node"))), least))
    forest = components(links)
    forest = staged(forest, "groups")
    alike = staged(rows.groupBy("doc", "t1", "t2").agg(F.count("*").alias("rows")).withColumn("node", named), "alike")
    member = alike.join(forest, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = F.struct("doc", "t1", "t2")
    keepers = staged(member.groupBy("root").agg(F.min(own).alias("least")), "keepers")
    return member.join(keepers, "root").select("doc", "t1", "t2", "rows", F.col("least.doc").alias("keeper"), (own == F.col("least")).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of near duplicates, with the columns of docs.

    It is the row of the least doc_id; if several texts of the group share that id, the text
    of the least hash, and one of the rows alike in both.  Texts without words are alike.
    """
    found = staged_alone(lambda: near_duplicate_groups(docs, **options), "near-duplicates")
    gone = found.where("not kept").select("doc", "t1", "t2")
    several = found.where("kept and rows > 1").select("doc", "t1", "t2")
    hashed = packed(
        docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty()).alias("t1"),
        F.xxhash64(text_or_empty(), F.lit("again")).alias("t2"),
    )
    # Rows that are surely neither gone nor repeated stay where they are; only the others are shuffled.
    named = F.xxhash64("doc", "t1", "t2")
    touched = gone.unionByName(several)
    maybe = key_filter(touched.select(named.alias("name")), "name")(named)
    free, open_rows = hashed.where(~maybe).select("row"), hashed.where(maybe)
    left = open_rows.join(touched, ["doc", "t1", "t2"], "left_anti").select("row")
    again = open_rows.join(several, ["doc", "t1", "t2"], "left_semi").dropDuplicates(["doc", "t1", "t2"]).select("row")
    return free.unionByName(left).unionByName(again).select(row_columns(docs))
