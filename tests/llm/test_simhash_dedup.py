import re

import numpy as np
import xxhash

from recordgate.llm.queries import op6_simhash_dedup
from recordgate.llm.simhash_dedup import blocks_to_agree, fingerprints_of, near_links, simhash_groups
from recordgate.llm.shared import load

from .helpers import AWKWARD, documents


def plain_fingerprint(text, width=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist():
            parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_query_matches_brute_force(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], plain_components(ids, fps), strict=True))
    assert sorted(tuple(r) for r in op6_simhash_dedup(spark, sf).collect()) == want
    assert len({w[2] for w in want}) < len(want)


def test_awkward_rows(spark):
    got = simhash_groups(documents(spark, AWKWARD)).collect()
    ids, fps = [r[0] for r in AWKWARD], [plain_fingerprint(r[1]) for r in AWKWARD]
    want = zip(ids, fps, plain_components(ids, fps), strict=True)
    key = lambda t: (t[0] is None, t[0] or 0)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash_groups(documents(spark, [])).count() == 0


def test_large_tiles_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (60, 2))]
    fps = sorted(set(fps) | set(rng.integers(0, 2**63, 400).tolist()))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components(signed, fps)
    for tile, total in ((8, len(fps)), (4096, len(fps)), (1, 10**9)):
        links = near_links(frame, total, 3, tile).collect()
        for a, b in links:
            assert ((a ^ b) % 2**64).bit_count() <= 3 * 60
        parent = {f: f for f in signed}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        least = {}
        for f in signed:
            least[root(f)] = min(f, least.get(root(f), f))
        assert [least[root(f)] for f in signed] == want


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [blocks_to_agree(n, 3) for n in (10, 10**6, 10**9, 10**11)] == [1, 1, 2, 3]


def test_even_split_of_bits_is_zero():
    assert fingerprints_of([None, ""], 3).tolist() == [0, 0]
    assert int(fingerprints_of(["a b"], 3)[0]) == plain_fingerprint("a b")
