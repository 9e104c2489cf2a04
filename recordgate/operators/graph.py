"""Many-to-many links: one-hop and two-hop expansions, access tests, changes of link sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hop(links: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return links.join(targets, key)


def two_hops(first: DataFrame, second: DataFrame, middle: str, start: str, end: str) -> DataFrame:
    """Distinct (start, end) over the middle; repeated links count once before they are joined."""
    return first.select(start, middle).distinct().join(second.select(middle, end).distinct(), middle).select(start, end).distinct()


def allowed(resources: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """resources + allowed: public, or linked."""
    linked = links.select(key).distinct().withColumn("__linked", F.lit(True))
    found = resources.join(linked, key, "left")
    return found.withColumn("allowed", F.col("is_public") | F.coalesce("__linked", F.lit(False))).drop("__linked")


def added(links: DataFrame, wanted: DataFrame, targets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(links with the wanted ones, wanted ones without a target); nobody with a reject gets any."""
    rejects = wanted.join(targets.select(key).distinct(), key, "left_anti")
    owner = [c for c in links.columns if c != key]
    accepted = wanted.join(rejects.select(*owner).distinct(), owner, "left_anti")
    return links.unionByName(accepted.select(*links.columns)).distinct(), rejects


def removed(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, links.columns, "left_anti")


def roots(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col(parent).isNull())
