"""Connected components of a link table, as a loop of joins and aggregations.

Large-star / small-star: every round each node hands its larger neighbours to its
smallest neighbour, then its smaller ones.  Nothing is collected; a round is two
aggregations with map-side combine and two equi joins, staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

_ROUNDS = 60


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that the links of a hub are split by Spark: both sides of the join are plain exchanges.
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least-neighbours")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = staged(links.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any integer ids -> (node, root): root is the least id reachable.

    Only nodes with a link to another node appear, roots included.  Null ids and
    self links are left out; repeated links count once; no links give no rows.
    """
    links = staged(_ordered(links.where("a is not null and b is not null")), "links")
    seen = None
    for _ in range(_ROUNDS):
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        links = staged(_ordered(_large_star(links)), "links")
        links = staged(_ordered(_small_star(links)), "links")
    else:
        raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
