"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is named by a 128-bit hash of its turns: the exclusive-or of a hash of each turn and its
place.  So hashes of prefixes are running sums, which are made inside the ranges
of a sort and then joined over the borders of ranges; a conversation of any
length is dealt to several ranges.

Totals of subtrees come up by contraction, in rounds of joins.  Each round rakes: nodes without children
give what they have to their parents and go.  Then it compresses: of nodes with one child
that follow each other, all but the first go, and the child below them takes over
what they have.  In even rounds these are runs on the longest path through a node (which all
nodes of an unbranched chain share), cut into blocks of depths that grow from round to round; in odd rounds
nodes whose coin shows heads and whose parent's shows tails, which is a
quarter of any chain and bounds the number of rounds.  When nothing is left, rounds are taken back in reverse order: the
child below a run knows the total of the run's first node, the others are less by what came before them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Conversations are put together with the head of the first of so many; heads have fewer turns than HEADS.
FAMILY, HEADS = 5, 9
#: Depths of the first blocks in which runs are compressed; each even round has blocks so many times deeper.
BLOCK = 64
#: After so many rounds are taken back, the totals so far are written.
KEEP = 5
_EMPTY = hashlib.sha256(b"").hexdigest()


def _runs(conv: np.ndarray, before) -> tuple[np.ndarray, bool]:
    """Where runs of one conversation start in a batch, and whether the first goes on from the batch before."""
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.zeros(0, int)
    return starts, bool(len(conv)) and before is not None and conv[0] == before


def _counting(batches):
    """(conv, ..., part) in order -> the same + k: number of the row in its conversation and partition, from 1."""
    last, seen = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if len(conv):
            starts, on = _runs(conv, last)
            k = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
            if on:
                k[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = conv[-1], int(k[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], [*batch.schema.names, "k"])


def _summing(batches):
    """(conv, g1, g2, ...) in order -> the same + p1, p2: exclusive-or of all g of the conversation in the partition so far."""
    last, carry = None, (0, 0)
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if len(conv):
            starts, on = _runs(conv, last)
            sums = []
            for column, before in zip((1, 2), carry, strict=True):
                g = np.bitwise_xor.accumulate(batch.column(column).to_numpy())
                earlier = np.where(starts > 0, g[starts - 1], before if on else 0)
                sums.append(g ^ np.repeat(earlier, np.diff(np.r_[starts, len(conv)])))
            last, carry = conv[-1], (sums[0][-1], sums[1][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], [*batch.schema.names, "p1", "p2"])


def numbered_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages -> (conv, rn, x1, x2, n_bytes, h, taken, length) of each turn in order, and (conv, base, h, taken, length) of each conversation.

    h: turns of the base's head; taken: how many of them the base has; length: turns when rebuilt.
    """
    clean = messages.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).where("conv is not null")
    order = ["conv", "turn", "role", "text"]
    hashed = clean.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit("second"), "text", "role").alias("x2"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"),
    )
    rows = staged(hashed.mapInArrow(_counting, "conv long, x1 long, x2 long, n_bytes long, part int, k long"), "turns")
    by_part = Window.partitionBy("conv").orderBy("part")  # a row for each range that holds some of the conversation
    ranges = rows.groupBy("conv", "part").agg(F.max("k").alias("n")).withColumn("before", F.sum("n").over(by_part) - F.col("n"))
    sizes = ranges.groupBy("conv").agg(F.sum("n").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h.alias("h"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = staged(convs, "conversations")
    # Keyed by range too, so that a very long conversation is no hot key.
    placed = rows.join(ranges.select("conv", "part", "before").join(convs.drop("base"), "conv"), ["conv", "part"])
    turns = placed.select("conv", (F.col("before") + F.col("k")).alias("rn"), "x1", "x2", "n_bytes", "h", "taken", "length")
    return staged(turns, "numbered-turns"), convs


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, n_bytes, length): the head of the base, then what follows the conversation's own head."""
    own = turns.where("rn > h").select("conv", (F.col("taken") + F.col("rn") - F.col("h")).alias("depth"), "x1", "x2", "n_bytes", "length")
    heads = turns.where(F.col("rn") < HEADS).select(F.col("conv").alias("base"), F.col("rn").alias("depth"), "x1", "x2", "n_bytes")
    head = heads.join(convs.select("conv", "base", "taken", "length"), "base").where("depth <= taken")
    return own.unionByName(head.select("conv", "depth", "x1", "x2", "n_bytes", "length"))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, u1, u2, n_bytes, length): the node of each prefix and its parent's."""
    order = ["conv", "depth"]
    ready = rebuilt.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("x1", "depth").alias("g1"), F.xxhash64("x2", "depth").alias("g2"), "depth", "n_bytes", "length", F.spark_partition_id().alias("part"),
    )
    rows = staged(ready.mapInArrow(_summing, "conv long, g1 long, g2 long, depth long, n_bytes long, length long, part int, p1 long, p2 long"), "prefixes")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv", "part").agg(*[F.max_by(p, "depth").alias(p) for p in ("p1", "p2")])
    # Only the first conversation of a range can have begun in an earlier one: at most a row for each range, so this is small at any size.
    begun = ends.select("conv", "part", *[F.expr(f"bit_xor({p})").over(earlier).alias(f"b{p[1]}") for p in ("p1", "p2")]).where("b1 is not null")
    joined = rows.join(F.broadcast(begun), ["conv", "part"], "left").na.fill(0, ["b1", "b2"])
    h = {n: F.col(f"p{n}").bitwiseXOR(F.col(f"b{n}")) for n in "12"}
    ups = [h[n].bitwiseXOR(F.col(f"g{n}")).alias(f"u{n}") for n in "12"]
    return joined.select("conv", "depth", h["1"].alias("h1"), h["2"].alias("h2"), *ups, "n_bytes", "length")


def _digests_of_chunks(batches):
    """(h1, h2, first, ids) in order -> (h1, h2, ends_sha256), one chunk in memory at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, sha.hexdigest()))
            node, sha = (a, b), hashlib.sha256(ids.encode())
        yield _digest_batch(out)
    if node is not None:
        yield _digest_batch([(*node, sha.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _chunks(batches):
    """(h1, h2, conv) in order -> (h1, h2, first, ids): conversations of one node in one batch, comma-joined."""
    for batch in batches:
        a, b, conv = (c.to_numpy() for c in batch.columns)
        if len(a):
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            names = list(map(str, conv.tolist()))
            ids = [",".join(names[i:j]) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(ids)], ["h1", "h2", "first", "ids"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (h1, h2, conv) -> h1, h2, ends_sha256.  Ids are joined in ranges of a sort, so that many ends of one node are text before they meet."""
    order = ["h1", "h2", "conv"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "h1 long, h2 long, first long, ids string")
    return chunks.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(_digests_of_chunks, "h1 long, h2 long, ends_sha256 string")


def _flipped(a: str, b: str, turn: int):
    return F.xxhash64(a, b, F.lit(turn)) % 2 == 0


def _compressed(chain: DataFrame, turn: int) -> DataFrame:
    """chain: nodes with one child (c1, c2) and a parent -> + gone, and for runs that go: the child below (e1, e2), the first node that stays (t1, t2),
    what comes before the node in its run and what all of the run has, and whether it is the run's last."""
    if turn % 2:
        gone = _flipped("h1", "h2", turn) & ~_flipped("u1", "u2", turn)
        return chain.select(
            "*", gone.alias("gone"), F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("u1").alias("t1"), F.col("u2").alias("t2"),
            F.lit(0).cast("long").alias("b_leaves"), F.lit(0).cast("decimal(38,0)").alias("b_saved"),
            F.col("leaves").alias("a_leaves"), F.col("saved").alias("a_saved"), F.lit(True).alias("end"),
        )
    # At most one node for each depth has this path, so a window holds a bounded number of nodes in the first round, and later what is left of as many.
    block = F.floor(F.col("depth") / (BLOCK ** (turn // 2 + 1)))
    path = Window.partitionBy("path", "block").orderBy("depth")
    same = F.coalesce((F.lag("h1").over(path) == F.col("u1")) & (F.lag("h2").over(path) == F.col("u2")), F.lit(False))
    dealt = chain.withColumn("block", block).withColumn("gone", same).withColumn("run", F.sum((~F.col("gone")).cast("int")).over(path))
    run = Window.partitionBy("path", "block", "run").orderBy("depth")
    all_of = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    going = lambda c: F.when(F.col("gone"), F.col(c))
    before = lambda c: F.coalesce(F.sum(going(c)).over(earlier), F.lit(0))
    whole = lambda c: F.coalesce(F.sum(going(c)).over(all_of), F.lit(0))
    return dealt.select(
        *chain.columns, "gone", F.last("c1").over(all_of).alias("e1"), F.last("c2").over(all_of).alias("e2"),
        F.first("h1").over(all_of).alias("t1"), F.first("h2").over(all_of).alias("t2"),
        before("leaves").cast("long").alias("b_leaves"), before("saved").cast("decimal(38,0)").alias("b_saved"),
        whole("leaves").cast("long").alias("a_leaves"), whole("saved").cast("decimal(38,0)").alias("a_saved"),
        F.lead("h1").over(run).isNull().alias("end"),
    )


_NODE = ["h1", "h2", "u1", "u2", "path", "depth", "leaves", "saved"]


def subtree_totals(tree: DataFrame) -> DataFrame:
    """tree (h1, h2, u1, u2, path, depth, saved): nodes, their parents (null for a root), and a path they share with a longest branch below
    -> h1, h2, leaves, saved: childless nodes and the sum of saved in each node's subtree.  Several trees go through together."""
    wide = F.col("saved").cast("decimal(38,0)").alias("saved")
    left = staged(tree.select(*_NODE[:-2], F.lit(0).cast("long").alias("leaves"), wide), "nodes")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while not left.isEmpty():
        turn = len(rounds)
        # What is left over when the raked children are taken out again of the exclusive-or is the only child.
        kids = left.where("u1 is not null").groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(F.count("*").alias("n"), F.expr("bit_xor(h1)").alias("c1"), F.expr("bit_xor(h2)").alias("c2"))
        known = staged(left.join(kids, ["h1", "h2"], "left"), "children")
        raked = known.where("n is null").select(*_NODE)
        if turn == 0:
            raked = raked.withColumn("leaves", F.lit(1).cast("long"))
        given = raked.where("u1 is not null").groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(
            F.sum("leaves").alias("g_leaves"), F.sum("saved").cast("decimal(38,0)").alias("g_saved"), F.count("*").alias("g_n"),
            F.expr("bit_xor(h1)").alias("g1"), F.expr("bit_xor(h2)").alias("g2"),
        )
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        inner = known.where("n is not null").join(given, ["h1", "h2"], "left").select(
            *_NODE[:-2], (F.col("leaves") + none("g_leaves")).alias("leaves"), (F.col("saved") + none("g_saved")).cast("decimal(38,0)").alias("saved"),
            (F.col("n") - none("g_n")).alias("n"), F.col("c1").bitwiseXOR(none("g1")).alias("c1"), F.col("c2").bitwiseXOR(none("g2")).alias("c2"),
        )
        in_chain = (F.col("n") == 1) & F.col("u1").isNotNull()
        others = inner.where(~in_chain).withColumn("gone", F.lit(False))
        marked = staged(_compressed(inner.where(in_chain), turn).unionByName(others, allowMissingColumns=True), "compressed")
        ends = marked.where("gone and end").select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), "t1", "t2", "a_leaves", "a_saved")
        kept = marked.where("not gone").select(*_NODE).join(ends, ["h1", "h2"], "left")
        left = staged(
            kept.select(
                "h1", "h2", F.coalesce("t1", "u1").alias("u1"), F.coalesce("t2", "u2").alias("u2"), "path", "depth",
                (F.col("leaves") + none("a_leaves")).alias("leaves"), (F.col("saved") + none("a_saved")).cast("decimal(38,0)").alias("saved"),
            ),
            "nodes",
        )
        rounds.append((raked.select("h1", "h2", "leaves", "saved"), None if ends.isEmpty() else marked))
    totals = None
    for n, (raked, marked) in enumerate(reversed(rounds)):
        if marked is not None and totals is not None:
            gone = marked.where("gone")
            back = gone.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "e1", "e2", "b_leaves", "b_saved").unionByName(
                gone.where("end").select(F.col("e1").alias("r1"), F.col("e2").alias("r2"), "e1", "e2", F.col("a_leaves").alias("b_leaves"), F.col("a_saved").alias("b_saved"))
            )
            back = back.withColumnsRenamed({"e1": "h1", "e2": "h2"})
            totals = totals.join(back, ["h1", "h2"], "left").select(
                F.coalesce("r1", "h1").alias("h1"), F.coalesce("r2", "h2").alias("h2"), (F.col("leaves") - F.coalesce("b_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") - F.coalesce("b_saved", F.lit(0))).cast("decimal(38,0)").alias("saved"),
            )
        totals = raked if totals is None else totals.unionByName(raked)
        if n % KEEP == KEEP - 1:
            totals = staged(totals, "totals")
    if totals is None:
        return tree.select("h1", "h2", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return totals.select("h1", "h2", "leaves", F.col("saved").cast("long").alias("saved"))


def conversation_trie(messages: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of messages (conv_id, turn, role, text, ...) when each conversation is rebuilt on the head of its family's first.

    Turns stand in order of turn, null first, those of one turn in order of role and text; repeated rows are
    further turns; null role or text counts as empty.  Rows with a null conv_id belong to no conversation and are left
    out; other columns are not read.  A conversation without turns once rebuilt is a member of the root; no conversations give
    no rows.  Gives conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (members that end here, ids joined by commas in ascending order).
    """
    turns, convs = numbered_turns(messages)
    rows = prefixes(rebuilt_turns(turns, convs))
    long = lambda n: F.lit(n).cast("long")
    found = rows.groupBy("h1", "h2").agg(
        F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"), F.max(F.struct("length", "conv"))["conv"].alias("path"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.struct("length", "conv"))["conv"].alias("path")).where("n_convs > 0")
    root = root.select(long(0).alias("h1"), long(0).alias("h2"), long(None).alias("u1"), long(None).alias("u2"), long(0).alias("depth"), "conv_id", "n_convs", long(0).alias("n_bytes"), "path")
    nodes = staged(found.unionByName(root), "trie")
    saved = (F.col("n_convs").cast("decimal(19,0)") - 1) * F.col("n_bytes").cast("decimal(19,0)")
    totals = subtree_totals(nodes.withColumn("saved", saved))
    children = nodes.where("u1 is not null").groupBy(F.col("u1").alias("h1"), F.col("u2").alias("h2")).agg(F.count("*").alias("n_children"))
    ends = rows.where("depth = length").select("h1", "h2", "conv").unionByName(convs.where("length = 0").select(long(0).alias("h1"), long(0).alias("h2"), "conv"))
    parents = nodes.select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, ["h1", "h2"]).join(children, ["h1", "h2"], "left").join(ends_digests(ends), ["h1", "h2"], "left").join(parents, ["u1", "u2"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", long(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def trie_sql(family: int = FAMILY, heads: int = HEADS) -> str:
    """DuckDB's SQL for the same rows: prefixes as lists of turns, CRC-32 by its table, subtrees by joins of each node with its ancestors."""
    return f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END FROM bits WHERE k < 8),
ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, p, v) AS (
  SELECT c, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, p + 1, xor(b.v, crc.v >> 8) FROM crc JOIN bits b ON b.k = 8 AND b.i = (xor(crc.v, CAST(ascii(substr(CAST(c AS VARCHAR), p + 1, 1)) AS BIGINT)) & 255) WHERE p < length(CAST(c AS VARCHAR))),
heads AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % {heads} AS h FROM crc WHERE p = length(CAST(c AS VARCHAR))),
own AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT heads.c, 0 AS part, rn, role, text FROM heads JOIN own ON own.c = heads.c - heads.c % {family} AND rn <= h
  UNION ALL SELECT own.c, 1, rn, role, text FROM own JOIN heads ON heads.c = own.c WHERE rn > h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, rn) AS d, role, text FROM parts),
prefixes AS (
  SELECT c, d, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS seq, strlen(text) AS bytes FROM rebuilt
  UNION ALL SELECT c, 0, CAST([] AS VARCHAR[][]), 0 FROM ids),
members AS (SELECT c, d, bytes, min(c) OVER (PARTITION BY d, seq) AS node, d = max(d) OVER (PARTITION BY c) AS ends FROM prefixes),
nodes AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended
  FROM members GROUP BY node, d),
placed AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.c = n.node AND m.d = n.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM placed WHERE parent IS NOT NULL GROUP BY 1, 2),
below AS (
  SELECT m.node, m.d, sum(x.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes x JOIN members m ON m.c = x.node AND m.d <= x.d LEFT JOIN children k ON k.node = x.node AND k.d = x.d GROUP BY 1, 2)
SELECT p.node AS conv_id, CAST(p.d AS BIGINT) AS depth, p.parent AS parent_conv_id, CAST(p.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(p.ended) AS ends_sha256
FROM placed p JOIN below b ON b.node = p.node AND b.d = p.d LEFT JOIN children k ON k.node = p.node AND k.d = p.d
"""
