"""A gate before a stream of delimited files: a file's header and first rows are checked, and only then is it read.

Each batch is a set of new files.  Their first lines are read first, without the rest; a file that lacks a required column
or has a fault in its first rows stays outside and leaves a row in the table of faults.  Files that pass are
read whole, those with one header together.  Empty files have nothing to give and are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contract as contracts
from ..sources import readers
from . import stream

FAULTS = "file string, fault string, column string, row_num long"
#: Rows of a file that are checked before it is let in.
FIRST_ROWS = 100


def heads(spark: SparkSession, files: list[str], rows: int = FIRST_ROWS) -> DataFrame:
    """(file, at, line): the header and first lines of each file, from the files' first splits alone."""
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    lines = lines.where("start = 0")
    # A file's first split is read by one task in order, so ids go up along its lines.
    first = lines.groupBy("file").agg(F.min("id").alias("first"))
    return lines.join(F.broadcast(first), "file").select("file", (F.col("id") - F.col("first")).alias("at"), "line").where(F.col("at") <= rows)


def checked_files(spark: SparkSession, files: list[str], contract: DataFrame, dataset: str, separator: str = ",", rows: int = FIRST_ROWS) -> tuple[dict[str, list[str]], DataFrame]:
    """(files that pass, by header line; faults of the others).  Files of one batch are few; only their names and headers come to the driver."""
    head = heads(spark, files, rows).persist()
    try:
        headers = {r["file"]: r["line"] for r in head.where("at = 0").collect()}
        needed = [r["column"] for r in contract.where((F.col("dataset") == dataset) & F.col("required")).collect()]
        spec = contract.where(F.col("dataset") == dataset)
        names = {line: [c.strip().strip('"') for c in line.split(separator)] for line in set(headers.values())}
        faults = [(f, "MISSING_COLUMN", c, None) for f, line in headers.items() for c in needed if c.lower() not in {n.lower() for n in names[line]}]
        bad = {f for f, *_ in faults}
        open_ = {line: [f for f, own in headers.items() if own == line and f not in bad] for line in names}
        found = spark.createDataFrame(faults, FAULTS)
        for line, own in open_.items():
            if own:
                cells = _first_cells(head.where(F.col("file").isin(own) & (F.col("at") > 0)), names[line], separator)
                columns = [c for c in names[line] if c.lower() in {r["column"].lower() for r in spec.collect()}]
                found = found.unionByName(contracts.cell_errors(cells, spec, ["file", "at"], columns).select("file", F.col("error_type").alias("fault"), "column", F.col("at").cast("long").alias("row_num")))
        kept = found.collect()  # a row for each fault in the first rows of the batch's files
    finally:
        head.unpersist()
    bad = {r["file"] for r in kept}
    return {line: own for line, fs in open_.items() if (own := [f for f in fs if f not in bad])}, spark.createDataFrame(kept, FAULTS)


def _first_cells(lines: DataFrame, names: list[str], separator: str) -> DataFrame:
    """file, at and the fields of each line, as text."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = F.from_csv("line", F.lit(kind.toDDL()), {"sep": separator, "quote": '"', "escape": '"'})
    return lines.where("trim(line) <> ''").select("file", "at", parsed.alias("r")).select("file", "at", *[F.col("r").getField(n).alias(n) for n in names])


def gated(contract: DataFrame, dataset: str, columns: list[str], write: Callable[[DataFrame, int], None], faults_path: str, separator: str = ",", rows: int = FIRST_ROWS) -> Callable[[DataFrame, int], None]:
    """Batch function over new files (path): rows of those that pass go to write, with these columns; faults go to faults_path."""

    def consume(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = [r["path"] for r in batch.select("path").collect()]  # as many as a trigger takes
        if not files:
            return
        passed, faults = checked_files(spark, files, contract, dataset, separator, rows)
        faults.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(faults_path)
        parts = []
        for line, own in sorted(passed.items()):
            names = [c.strip().strip('"') for c in line.split(separator)]
            raw = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').schema(readers.text_schema(names)).csv(own)
            parts.append(readers.bound(raw, columns))
        if parts:
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            write(whole, number)

    return consume


def new_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the names of files that come to a folder; their contents are not read."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path).select("path")


def run(spark: SparkSession, path: str, checkpoint: str, consume: Callable[[DataFrame, int], None], files_per_batch: int = 1000) -> int:
    return stream.run_batches(new_files(spark, path, files_per_batch), consume, checkpoint)
