"""Reports over job, sheet and step logs: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of sheets that are at work, and that are final.
IN_PROGRESS = ("INGESTING", "VALIDATING", "INSERTING")
FINAL = ("COMPLETED", "FAILED")


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def counts_map(df: DataFrame, group: str, category: str, value: Column) -> DataFrame:
    """group -> a map of category to sum, in order of category."""
    each = df.groupBy(group, category).agg(F.sum(value).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct(category, "v")))
    return each.groupBy(group).agg(F.map_from_entries(entries).alias("by_category"))


def rate(rows: Column, millis: Column) -> Column:
    """Rows a second, 0 where no time is known."""
    return F.when(millis > 0, rows * 1000.0 / millis).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def any_of(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def overall_status(status: Column) -> Column:
    """One status of a job from its sheets': at work, all done, some failed, or waiting."""
    return (
        F.when(any_of(status.isin(*IN_PROGRESS)), "STARTED")
        .when(F.bool_and(status == "COMPLETED"), "COMPLETED")
        .when(any_of(status == "FAILED"), "COMPLETED_WITH_ERRORS")
        .otherwise("PENDING")
    )


def slowest(step: Column, millis: Column) -> tuple[Column, Column]:
    """Name of the slowest step, ties to the least name, and its share of all time in percent."""
    name = F.max(F.struct(millis, F.lit(0))).isNotNull()
    best = F.min(F.struct((-millis).alias("m"), step.alias("s")))
    return best["s"], F.when(name & (F.sum(millis) > 0), -best["m"] * 100.0 / F.sum(millis)).otherwise(0.0)


def health(error_rate: Column) -> Column:
    """A ladder over the share of errors in percent."""
    return F.when(error_rate > 10, "CRITICAL").when(error_rate > 5, "WARNING").otherwise("HEALTHY")
