"""An error budget: a stream stops when it has met more errors than it may, before it reads on.

Errors are counted while a batch is written, so a batch is passed over once.  What each batch met is kept in a
table by batch, so the budget holds over stops, and a batch that is run again counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

_SPENT = "batch long, rows long, errors long"
#: In the message of the error that stops a stream.
SPENT = "the error budget is spent"


class BudgetSpent(RuntimeError):
    pass


class ErrorBudget:
    """At most so many rows with errors; of these the first ones are kept whole, as many as details says."""

    def __init__(self, spark: SparkSession, folder: str, most: int, details: int = 1000):
        self.spark, self.folder, self.most, self.details = spark, folder, most, details

    def batches(self) -> DataFrame:
        """What each batch met so far."""
        try:
            return self.spark.read.schema(_SPENT).parquet(f"{self.folder}/batches")
        except Exception as missing:  # before the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], _SPENT)

    def spent(self, before: int | None = None) -> int:
        """Rows with errors so far, of earlier batches only if a batch is given."""
        known = self.batches() if before is None else self.batches().where(F.col("batch") < before)
        return known.agg(F.coalesce(F.sum("errors"), F.lit(0))).first()[0]

    def consumer(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """Batch function: writes rows (..., errors) by write, which reads them once, and raises when the budget is gone."""

        def consume(batch: DataFrame, number: int) -> None:
            earlier = self.spent(before=number)
            if earlier > self.most:
                raise BudgetSpent(SPENT)
            seen, wrong = Observation(), F.size("errors") > 0
            write(batch.observe(seen, F.count("*").alias("rows"), F.count_if(wrong).alias("errors")), number)
            got = seen.get
            if got["errors"] and earlier < self.details:
                self._by_batch(batch.where(wrong).limit(self.details - earlier), "details", number)
            row = self.spark.createDataFrame([(got["rows"], got["errors"])], "rows long, errors long")
            self._by_batch(row, "batches", number)
            if earlier + got["errors"] > self.most:
                raise BudgetSpent(SPENT)

        return consume

    def _by_batch(self, df: DataFrame, name: str, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/{name}")

    def run(self, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> bool:
        """Put all that is there through, batch by batch; whether it got to the end within the budget."""
        query = stream.writeStream.foreachBatch(self.consumer(write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as stopped:
            if SPENT not in str(stopped):
                raise
            return False
        return True


class StopAtBudget(StreamingQueryListener):
    """For sinks of Spark's own: stops a query whose observed errors (watched() below) have gone beyond the budget.

    Progress comes after a batch, so a query may be in its next one when it is stopped.
    """

    def __init__(self, spark: SparkSession, name: str, most: int):
        self.spark, self.name, self.most, self.errors, self.batches = spark, name, most, 0, 0

    def watched(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.name, F.count_if(F.size("errors") > 0).alias("errors"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        self.errors += row["errors"]
        self.batches += 1
        if self.errors > self.most:
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
