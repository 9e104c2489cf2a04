"""References: rows whose key a master table lacks, or has already.

Masters are plain equi joins: the optimizer broadcasts them where their size allows,
and splits skewed keys where it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(master: DataFrame) -> DataFrame:
    return master.where("is_active")


def unresolved(df: DataFrame, master: DataFrame, key: Column, master_key: str) -> DataFrame:
    """Rows with a key that no row of master has; rows without a key are not asked."""
    known = master.select(F.col(master_key).alias("__known")).distinct()
    return df.where(key.isNotNull()).join(known, key == F.col("__known"), "left_anti")


def unresolved_keys(df: DataFrame, master: DataFrame, key: str, master_key: str) -> DataFrame:
    """The distinct keys that master lacks: few rows to join, whatever the size of df."""
    return unresolved(df.select(key).distinct(), master, F.col(key), master_key)


def with_presence(df: DataFrame, master: DataFrame, key: Column, master_key: str, name: str) -> DataFrame:
    """df + a flag: whether master has the key; one left join, so that several checks make one plan."""
    known = master.select(F.col(master_key).alias("__known")).distinct().withColumn("__found", F.lit(True))
    return df.join(known, key == F.col("__known"), "left").withColumn(name, F.coalesce("__found", F.lit(False))).drop("__known", "__found")


def existing(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key target has already; null parts match nothing."""
    return df.join(target.select(*keys).distinct(), keys, "left_semi")


def not_in(df: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(rejected.select(*keys), keys, "left_anti")


def resolved_facts(facts: DataFrame, units: DataFrame, boxes: DataFrame) -> DataFrame:
    """Facts with the codes of their unit and box in place of the ids."""
    u = units.select(F.col("id").alias("unit_id"), F.col("code").alias("unit_code"))
    b = boxes.select(F.col("id").alias("box_id"), F.col("code").alias("box_code"))
    return facts.join(u, "unit_id").join(b, "box_id").drop("unit_id", "box_id")
