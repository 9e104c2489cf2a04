import random

import numpy as np
import pytest

import corpus_pipeline

from recordgate.llm import near_duplicates as N
from recordgate.llm.near_duplicates import near_duplicate_groups, without_near_duplicates
from recordgate.llm.shared import load, staged

from .helpers import AWKWARD, documents


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_keepers(rows, least=0.8):
    """Least doc_id of each row's group."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= least:
                parent[root(i)] = root(j)
    found = {}
    for i, (d, _) in enumerate(rows):
        found[root(i)] = min(d, found.get(root(i), d))
    return {d: found[root(i)] for i, (d, _) in enumerate(rows)}


def test_groups_match_brute_force(spark, sf):
    rows = [tuple(r) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    want = plain_keepers(rows)
    got = {r.doc: r.keeper for r in near_duplicate_groups(load(spark, sf, "documents")).collect()}
    assert got == want
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, load(spark, sf, "documents"), sf).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def family(rng, size, edits, start=0):
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for k in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(300)] = f"x{start + k}"
        rows.append((start + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [5, 16_384])
def test_large_families(spark, monkeypatch, tile):
    # Tiles of more than SMALL texts, whose members do not all reach the similarity with one another, and of
    # hot shingles, which are dealt to several tiles; then pairs across clusters, block by block.
    for name, value in (("SMALL", 4), ("PIVOTS", 2), ("SAMPLE", 1), ("TILE", tile), ("FAMILY_BLOCK", 7), ("FAMILY_ROWS", 10)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(2)
    rows = family(rng, 60, 12) + family(rng, 20, 30, 100)
    rows += [(200 + k, " ".join(f"y{k}z{i}" for i in range(50))) for k in range(5)]
    got = {r.doc: r.keeper for r in near_duplicate_groups(documents(spark, rows)).collect()}
    assert got == plain_keepers(rows)


def test_pairs_across_clusters_are_all_found():
    rng = np.random.default_rng(3)
    for sides in (1, 2):
        n = 3000
        pair, side = np.sort(rng.integers(0, 3, n)), rng.integers(0, sides, n) if sides > 1 else np.full(n, -1)
        root, size = rng.integers(0, 40, n), rng.integers(10, 40, n)
        root[rng.random(n) < 0.5] = 7
        fp = rng.integers(0, 2**63, 20).astype(np.uint64)[rng.integers(0, 20, n)] ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64))
        rest = size - rng.integers(0, 6, n)
        a, b = N.pairs_across(pair, side, root, size, fp, rest, 0.8, 3)
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        i, j = np.triu_indices(n, 1)
        near = (pair[i] == pair[j]) & (root[i] != root[j]) & N._candidates(fp, size, rest, i, j, 0.8, 3)
        near &= (side[i] != side[j]) if sides > 1 else True
        assert got == set(zip(i[near].tolist(), j[near].tolist(), strict=True)) and len(got) > 100


def test_awkward_rows(spark):
    kept = without_near_duplicates(documents(spark, AWKWARD))
    assert kept.columns == documents(spark, []).columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    # Null and empty texts are alike; 6, 7 and 7 are equal.
    assert ids == [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5), (True, 6), (True, 9)]
    twice = without_near_duplicates(documents(spark, [(7, "a b c"), (7, "a b c"), (7, "d e f")]))
    assert sorted(r.text for r in twice.collect()) == ["a b c", "d e f"]
    assert without_near_duplicates(documents(spark, [])).count() == 0


def test_pairs_beyond_the_radius_are_linked(spark):
    from recordgate.llm.simhash_dedup import fingerprints_of

    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        # A line said over and over moves the fingerprint, and adds few shingles to the set.
        line = [f"z{rng.randrange(10**6)}" for _ in range(6)]
        rows += [(2 * k, " ".join(base + line * (k % 3) * 10)), (2 * k + 1, " ".join(base + line * 30))]
    rows += [(200 + k, " ".join([f"common {k}", *(f"c{i}" for i in range(30)), *(f"d{k}e{i}" for i in range(40))])) for k in range(50)]
    fps = fingerprints_of([t for _, t in rows], 3)
    beyond = [k for k in range(60) if (int(fps[2 * k]) ^ int(fps[2 * k + 1])).bit_count() > 12]
    assert len(beyond) > 10
    got = {r.doc: r.keeper for r in near_duplicate_groups(documents(spark, rows)).collect()}
    assert got == plain_keepers(rows)
    assert all(got[2 * k + 1] == 2 * k for k in range(60))
    assert without_near_duplicates(documents(spark, rows)).count() == 110


def test_sets_are_made_for_candidates_only_and_shuffled_once_more(spark, sf, monkeypatch):
    """Texts that share a tile and are no candidates are not read again, and a set meets its family without a join."""
    seen = {}
    monkeypatch.setattr(N, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    links = N.family_links
    monkeypatch.setattr(N, "family_links", lambda *given: seen.setdefault("links", links(*given)))
    near_duplicate_groups(load(spark, sf, "documents"))
    nodes = lambda name, *columns: {v for r in seen[name].select(*columns).collect() for v in r}
    asked = nodes("families", "node") | (nodes("candidates-across", "a", "b") if "candidates-across" in seen else set())
    assert nodes("shingle-sets", "node") == asked < nodes("tiles-met", "a")
    assert "Join" not in seen["links"]._jdf.queryExecution().optimizedPlan().toString()
