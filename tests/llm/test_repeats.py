"""Suffix-array and substring dedup against plain versions over all windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from recordgate.llm import anchors as A
from recordgate.llm.queries import op1_suffix_dedup, op5_substring_dedup
from recordgate.llm.shared import load
from recordgate.llm.substring_dedup import repeated_depths, substring_dedup, tree_depths
from recordgate.llm.suffix_dedup import repeated_reach, suffix_dedup
from recordgate.llm.suffix_sort import common_prefix, deep_shallow_order

from .helpers import AWKWARD, documents


def plain_bytes(rows, width):
    """rows (doc_id, text) -> the rows of op1, in order of rows."""
    data = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - width + 1):
            seen[d[i : i + width]] += 1
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for order in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
        for i in range(len(words[order]) - width + 1):
            first.setdefault(tuple(words[order][i : i + width]), (rows[order], i))
    out = []
    for row, own in zip(rows, words, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] != (row, i):
                gone[i : i + width] = [True] * width
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((row[0], len(own), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def test_suffix_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    want = plain_bytes(rows, 200)
    assert by_id(op1_suffix_dedup(spark, sf).collect()) == by_id(want)
    assert sum(w[2] for w in want) > 0


def test_substring_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in load(spark, sf, "documents").select("doc_id", "text").collect()]
    want = plain_words(rows, 20)
    assert by_id(op5_substring_dedup(spark, sf).collect()) == by_id(want)
    assert sum(w[2] for w in want) > 0


def noisy_rows(seed, n, alphabet="ab ", length=120):
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(length))
    rows = []
    for k in range(n):
        t = list(base[rng.randrange(40) : length - rng.randrange(40)])
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        rows.append((k, "".join(t)))
    return rows


@pytest.mark.parametrize("group", [50_000, 3])
def test_suffix_dedup_of_near_copies(spark, group):
    rows = noisy_rows(1, 40) + noisy_rows(2, 30, "abcdefgh", 300)[:30]
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(900, "aaaa" * 30)]
    got = suffix_dedup(documents(spark, rows), width=24, gram=8, group=group, shallow=16).drop("kept").collect()
    assert by_id(got) == by_id(plain_bytes(rows, 24))


@pytest.mark.parametrize("group", [50_000, 3])
def test_substring_dedup_of_near_copies(spark, group):
    rows = noisy_rows(3, 40, "ab    ", 160) + [(500, "x y " * 60)]
    got = substring_dedup(documents(spark, rows), width=6, gram=2, group=group).drop("kept").collect()
    assert by_id(got) == by_id(plain_words(rows, 6))


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    # Repeated rows are texts of their own for the suffix operator, and one place for the other.
    assert by_id(suffix_dedup(documents(spark, rows), width=24, gram=8).drop("kept").collect()) == by_id(plain_bytes(rows, 24))
    got = substring_dedup(documents(spark, rows), width=5, gram=2).drop("kept").collect()
    assert by_id(got) == by_id(plain_words(rows, 5))
    assert suffix_dedup(documents(spark, [])).count() == 0
    assert substring_dedup(documents(spark, [])).count() == 0


def test_many_repeated_rows(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(120))
    rows = [(7, text)] * 1200 + [(k, text[k : 300 + k]) for k in range(20)] + [(7, "another text of the same id, with words of its own, and more of them")] * 2
    assert by_id(suffix_dedup(documents(spark, rows), width=24, gram=8).drop("kept").collect()) == by_id(plain_bytes(rows, 24))
    got = substring_dedup(documents(spark, rows), width=5, gram=2).drop("kept").collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got}) == len(set(rows))


@pytest.mark.parametrize("hot", [1, 2000, 10**9])
def test_hot_anchors_are_joined_where_they_lie(spark, monkeypatch, hot):
    monkeypatch.setattr(A, "HOT", hot)
    rows = noisy_rows(6, 30, "ab    ", 160) + [(500, "x y " * 200), (501, "x y " * 150)]
    assert by_id(substring_dedup(documents(spark, rows), width=6, gram=2).drop("kept").collect()) == by_id(plain_words(rows, 6))
    assert by_id(suffix_dedup(documents(spark, rows), width=24, gram=8).drop("kept").collect()) == by_id(plain_bytes(rows, 24))


def test_nodes_of_a_suffix_tree():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 30))
        rows, length, prefix = rng.integers(1, 3, (n, 8)).astype(np.uint64), rng.integers(0, 9, n), rng.integers(0, 2, n)
        rows[np.arange(8)[None, :] >= length[:, None]] = 0
        got = repeated_depths(*tree_depths(rows, length, prefix), 3)
        for i in range(n):
            shared = [int(np.argmin([*(rows[i, :m] == rows[j, :m]), False])) for j in range(i) if prefix[i] == prefix[j] for m in [min(length[i], length[j])]]
            want = max(shared, default=0)
            assert got[i] == (want if want >= 3 else 0)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 500)
    rows = noisy_rows(5, 6, "abcd ", 2000)
    shape = A.Shape(24, 8, words=False)
    values = {t: A.token_values(t, shape) for _, t in rows}
    for _, t in rows:
        whole, *_ = A.find_anchors(values[t], A.np.array([0]), A.np.array([len(values[t])]), shape)
        parts = []
        for first, last, low, high in A._pieces(len(t), 48):
            at, *_ = A.find_anchors(values[t][first:last], A.np.array([0]), A.np.array([last - first]), shape)
            parts += [p + first for p in at.tolist() if low <= p + first < high]
        assert parts == whole.tolist()


def test_deep_shallow_sorting():
    rng = random.Random(7)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(1, 40))]
        strings += [b"z" * 70 + s for s in strings] + strings[:3]
        order = deep_shallow_order(strings, rng.choice([0, 16, 64]))
        assert [strings[i] for i in order] == sorted(strings)
        assert sorted(order) == list(range(len(strings)))
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"", b"x") == 0


def test_reach_of_large_and_small_groups_agrees(monkeypatch):
    from recordgate.llm import suffix_dedup as S

    rng = random.Random(11)
    for _ in range(30):
        n = rng.randrange(2, 30)
        befores = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(n)]
        afters = [b"gram" + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(n)]
        monkeypatch.setattr(S, "_PAIRS", 400)
        small = repeated_reach(befores, afters, 12, 4)
        monkeypatch.setattr(S, "_PAIRS", 0)
        large = repeated_reach(befores, afters, 12, 4)
        covered = lambda r: [(a, b) if b else (0, 0) for a, b in zip(r[0].tolist(), r[1].tolist(), strict=True)]
        assert covered(small) == covered(large)
