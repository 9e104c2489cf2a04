"""Streams of record files: batches through a function, uniqueness, checks, resumption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rules
from ..operators.dedupe import first_of_each


def files(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_batch: int = 1, **options) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).format(format).load(path)


def run_batches(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Put all that is there through consume, batch by batch, and stop; a later call goes on where this one ended.  Gives batches done."""
    query = stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])


def accept_unique(path: str, rejects: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Batch function: the first row of each key goes to path, all others to rejects.

    State is the accepted table itself, so it lives as long as the table and is no burden to
    memory.  The batch number goes with the rows, so a batch that is run again after a
    failure replaces its own partition and nothing else.
    """

    def consume(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = first_of_each(batch, key, order)
        try:
            there = spark.read.parquet(path).where(F.col("batch") != number).select(*key)
        except Exception as missing:  # the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            there = None
        fresh = once if there is None else once.join(there, key, "left_anti")
        # What is accepted is read by the rejects' plan too, so both come from the batch and the earlier batches alone.
        taken = fresh.select(*key, F.col(order).alias("__taken"))
        gone = batch.join(taken, key, "left").where(F.col("__taken").isNull() | (F.col("__taken") != F.col(order))).drop("__taken")
        for df, target in ((gone, rejects), (fresh.select(*batch.columns), path)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return consume


def append_once(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch function: rows whose key the table lacks are appended."""
    return accept_unique(path, f"{path.rstrip('/')}-rejects", key, key[0])


def checked(stream: DataFrame, made: list[rules.Rule]) -> DataFrame:
    """stream + errors: the same rule columns as in a batch."""
    return stream.withColumn("errors", rules.error_list(made))


def running_error_counts(stream: DataFrame) -> DataFrame:
    """Errors per type so far, for output mode complete."""
    return stream.select(F.explode("errors").alias("e")).groupBy(F.col("e.error_type").alias("error_type")).count()


def tolerant(consume: Callable[[DataFrame, int], None], results: str, most_failures: int) -> Callable[[DataFrame, int], None]:
    """Batch function: a failed batch is written down in results and the rest goes on, up to so many failures in one run."""
    failures: list[int] = []

    def guarded(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            consume(batch, number)
            status, message = "OK", None
        except Exception as failure:
            status, message = "FAILED", str(failure)[:500]
        row = spark.createDataFrame([(number, status, message)], "number long, status string, message string")
        row.write.mode("append").parquet(results)
        if status == "FAILED":
            failures.append(number)
        if len(failures) > most_failures:
            raise RuntimeError(f"more than {most_failures} batches failed; the last: {message}")

    return guarded
