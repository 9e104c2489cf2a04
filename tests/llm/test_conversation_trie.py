"""The conversation trie against a plain one, and tree contraction on trees of all shapes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from recordgate.llm import conversation_trie as trie
from recordgate.llm.conversation_trie import conversation_trie, subtree_totals

MESSAGES = T.StructType([T.StructField(n, k) for n, k in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("depth", T.StringType()), ("h1", T.StringType()), ("conv", T.LongType()))])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows: (conv_id, turn, role, text) -> rows of the query, by sets of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        own_bytes = len(seq[-1][1].encode()) if seq else 0
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = (len(members[seq]) - 1) * own_bytes + sum(saved[k] for k in kids[seq])
    ends = lambda seq: ",".join(str(c) for c in members[seq] if len(rebuilt[c]) == len(seq))
    return sorted(
        (m[0], len(seq), members[seq[:-1]][0] if seq else None, len(m), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(ends(seq).encode()).hexdigest())
        for seq, m in members.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], MESSAGES)
    return sorted(map(tuple, conversation_trie(df).select(COLUMNS).collect()))


def made(seed):
    """Families with shared heads, long conversations, ties, repeated rows, nulls and negative ids."""
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 100, 101, 102]:
        if r.random() < 0.15:
            continue
        for turn in range(r.choice([1, 3, 8, 12, 40])):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", "é", None, ""])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(20)]
    rows += [(c, t, "user", "long") for c, n in ((300, 400), (301, 250), (305, 390)) for t in range(n)]
    rows += rows[:40] + [(None, 1, "user", "no conversation"), (7, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    rows = made(seed)
    assert found(spark, rows) == plain(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(4, 0, None, None)], [(0, 0, "user", "x")], [(1, 0, "user", "x"), (2, 0, "user", "x")]):
        assert found(spark, rows) == plain(rows)


def test_conversations_over_borders_of_ranges(spark, monkeypatch):
    """With many small ranges, numbers and prefixes of long conversations are joined over their borders."""
    rows = made(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_ends_of_one_node_are_hashed_in_pieces(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1L as h1", "2L as h2", "id as conv").repartition(5)
    (row,) = trie.ends_digests(df).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()


def _tree(shape, n, r):
    if shape == "chain":
        return [None, *range(n - 1)]
    if shape == "star":
        return [None] + [0] * (n - 1)
    if shape == "binary":
        return [None] + [(i - 1) // 2 for i in range(1, n)]
    if shape == "caterpillar":  # a leaf at each node of a chain
        return [None] + [i - 1 if i % 2 else max(i - 2, 0) for i in range(1, n)]
    if shape == "combs":  # chains hanging off a chain, shorter further down
        parents, spine = [None], 0
        for length in range(14, 0, -1):
            at = spine
            for _ in range(length):
                parents.append(at)
                at = len(parents) - 1
            parents.append(spine)
            spine = len(parents) - 1
        return parents
    return [None] + [r.randint(max(0, i - 6), i - 1) for i in range(1, n)]


@pytest.mark.parametrize("shape", ["chain", "star", "binary", "caterpillar", "combs", "random"])
def test_contraction_of_trees(spark, monkeypatch, shape):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "KEEP", 2)
    r = random.Random(shape)
    parents = _tree(shape, 120, r)
    n = len(parents)
    depth, deepest, path = [0] * n, list(range(n)), list(range(n))
    for i in range(1, n):
        depth[i] = depth[parents[i]] + 1
    leaves, saved, own = [0] * n, [r.randint(0, 9) for _ in range(n)], None
    own = list(saved)
    reach = list(depth)
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if i:
            p = parents[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            if reach[i] > reach[p]:
                reach[p], path[p] = reach[i], path[i]
    name = lambda i: None if i is None else (i * 7919 + 13) ^ 0x5DEECE66D
    rows = [(name(i), i, name(parents[i]), parents[i], path[i], depth[i], own[i]) for i in range(n)]
    tree = spark.createDataFrame(rows, "h1 long, h2 long, u1 long, u2 long, path long, depth long, saved long")
    got = {x["h2"]: (x["leaves"], x["saved"]) for x in subtree_totals(tree).collect()}
    assert got == {i: (leaves[i], saved[i]) for i in range(n)}
