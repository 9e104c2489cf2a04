"""Appending each key once, over any number of runs: a ledger of commits over a table in buckets by key.

The table is partitioned by bucket (a hash of the key) and commit (job and batch).  A commit counts when the ledger
names it, which is written last; files of a commit that is not in the ledger are not there for
readers, and the next try of the same batch replaces them.  Before rows are appended, keys are looked up only
in the buckets that the batch touches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import first_of_each

_LEDGER = "job string, batch long, commit string, rows long, buckets array<int>"


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at path, or nothing where none was written yet."""
    reader = spark.read.schema(schema) if isinstance(schema, str) else spark.read
    try:
        found = reader.parquet(path)
        found.schema  # noqa: B018  names the columns only where there are files
        return found
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


@dataclass(frozen=True)
class Ledger:
    """A table at folder/rows whose key is unique, and its ledger at folder/ledger.  buckets is fixed for the table's life."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    buckets: int = 64

    @property
    def rows_path(self) -> str:
        return f"{self.folder}/rows"

    def commits(self) -> DataFrame:
        found = _read(self.spark, f"{self.folder}/ledger", _LEDGER)
        return self.spark.createDataFrame([], _LEDGER) if found is None else found

    def bucket(self):
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in self.key]), F.lit(self.buckets)).cast("int")

    def _committed(self, of_buckets: list[int] | None = None) -> DataFrame | None:
        found = _read(self.spark, self.rows_path, None)
        if found is None:
            return None
        if of_buckets is not None:
            found = found.where(F.col("bucket").isin(of_buckets))  # prunes folders
        return found.join(self.commits().select("commit"), "commit", "left_semi")

    def rows(self) -> DataFrame | None:
        """Rows of all commits in the ledger; nothing before the first."""
        found = self._committed()
        return None if found is None else found.drop("bucket", "commit")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets that the batch has keys for: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())

    def write(self, batch: DataFrame, job: str, number: int, order: str | None = None) -> int:
        """Append the rows of batch whose key the table lacks, one for each key, as commit number of the job.

        Null parts of a key are equal to each other.  A commit that the ledger has already is left as it is.  Gives the rows appended.
        """
        if not self.commits().where((F.col("job") == job) & (F.col("batch") == number)).isEmpty():
            return 0
        name, touched = f"of-{job}-{number}", self.touched(batch)
        self._discard(name)  # before the table's files are listed
        once = first_of_each(batch, list(self.key), order or self.key[0]).withColumn("bucket", self.bucket())
        there = self._committed(touched)
        if there is not None:
            same = [once[c].eqNullSafe(there[c]) for c in self.key]
            once = once.join(there, [once["bucket"] == there["bucket"], *same], "left_anti")
        # A folder for each bucket and commit: another try of this commit replaces its own folders and no others.
        fresh, seen = once.select(*batch.columns, "bucket").withColumn("commit", F.lit(name)), Observation()
        fresh.repartition("bucket").observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy("bucket", "commit").parquet(self.rows_path)
        return self._commit(job, number, name, seen.get["n"], touched)

    def _discard(self, name: str) -> None:
        """Remove what an earlier try of this commit left: it may have had other rows."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.rows_path}/bucket=*/commit={name}")
        files = pattern.getFileSystem(conf)
        for status in files.globStatus(pattern) or []:
            files.delete(status.getPath(), True)

    def _commit(self, job: str, number: int, name: str, rows: int, touched: list[int]) -> int:
        self.spark.createDataFrame([(job, number, name, rows, touched)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return rows

    def consumer(self, job: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """A stream's batch function: batch after batch as commits of the job."""

        def consume(batch: DataFrame, number: int) -> None:
            self.write(batch, job, number, order)

        return consume
