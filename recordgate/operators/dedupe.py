"""Duplicates inside a batch: by window over the key's columns, null parts being equal to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(keys: list[Column], order: str = "row_num") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def mark_repeats(df: DataFrame, keys: list[Column], order: str = "row_num") -> DataFrame:
    """df + place (1 for the first of its key) + first_row: the first one's row number."""
    w = by_key(keys, order)
    return df.withColumn("place", F.row_number().over(w)).withColumn("first_row", F.first(order).over(w))


def repeats(df: DataFrame, keys: list[Column], order: str = "row_num") -> DataFrame:
    """Second and later rows of a key."""
    return mark_repeats(df, keys, order).where("place > 1")


def repeats_in_range(df: DataFrame, keys: list[Column], size: int, order: str = "row_num") -> DataFrame:
    """Repeats within stretches of size row numbers only: the bounded form of repeats()."""
    return repeats(df, [F.floor((F.col(order) - 1) / size), *keys], order)


def previous_row(df: DataFrame, value: str, order: str = "row_num") -> DataFrame:
    """Rows whose value stood before, with the number of the row that had it last; blanks are no values."""
    w = Window.partitionBy(value).orderBy(order)
    given = df.where(F.trim(F.col(value)) != "")
    return given.withColumn("previous_row", F.lag(order).over(w)).where("previous_row is not null")


def group_size(df: DataFrame, keys: list[Column], order: str = "row_num") -> DataFrame:
    return df.withColumn("group_size", F.count("*").over(Window.partitionBy(*keys))).withColumn("place", F.row_number().over(by_key(keys, order)))


def surplus(df: DataFrame, keys: list[Column]) -> Column:
    """count - distinct keys, null parts counted like any value."""
    return (F.count("*") - F.count_distinct(F.struct(*keys))).alias("surplus")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the least order value for each key; the key is pre-aggregated, so hot keys are no burden."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.col(order)).alias("kept")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest])
