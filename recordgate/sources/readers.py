"""Readers: every field as text, names bound without regard to case, blank as null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null

BAD = "_bad_record"


def text_schema(names: list[str], bad: bool = False) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([BAD] if bad else [])]])


def bound(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by the given names, found without regard to case and outer blanks; those that lack are null, others are dropped."""
    there = {c.strip().lower(): c for c in df.columns}
    found = [(n, there.get(n.lower())) for n in names]
    return df.select(*[(blank_to_null(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(n) for n, c in found])


def header_of(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    return spark.read.option("header", True).option("sep", separator).csv(path).columns


def _halves(raw: DataFrame, first: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines.  Spark reads no file for the mark alone, so a field is always asked for: any has a length of 0 or more."""
    parsed = raw.where(F.length(F.concat_ws("", F.col(f"`{first}`"))) >= 0)
    return parsed.where(F.col(BAD).isNull()).drop(BAD), parsed.where(F.col(BAD).isNotNull()).select(BAD)


def read_delimited(spark: SparkSession, path: str, names: list[str], separator: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): text fields, quoted ones too; without a header fields are bound by their place."""
    own = header_of(spark, path, separator) if header else names
    raw = (
        spark.read.option("header", header).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", False)
        .option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        .schema(text_schema(own, bad=True)).csv(path)
    )
    good, bad = _halves(raw, own[0])
    return bound(good, names), bad


def read_json(spark: SparkSession, path: str, names: list[str], lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records): a record per line, or one document that is an array or an object."""
    raw = (
        spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        .option("primitivesAsString", True).schema(text_schema(names, bad=True)).json(path)
    )
    good, bad = _halves(raw, names[0])
    return good.select(*[blank_to_null(F.col(n)).alias(n) for n in names]), bad


def _parquet(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(path)
    return bound(df.select(*[F.col(c).cast("string") for c in df.columns]), names), spark.createDataFrame([], text_schema([BAD]))


Reader = Callable[[SparkSession, str, list[str]], tuple[DataFrame, DataFrame]]
READERS: dict[str, Reader] = {
    "csv": read_delimited,
    "txt": lambda spark, path, names: read_delimited(spark, path, names, "\t"),
    "json": lambda spark, path, names: read_json(spark, path, names, lines=False),
    "jsonl": read_json,
    "parquet": _parquet,
}


def register_reader(extension: str, reader: Reader) -> None:
    READERS[extension.lower().lstrip(".")] = reader


def reader_for(path: str) -> Reader:
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in READERS:
        raise ValueError(f"no reader for {extension!r}; there are {', '.join(sorted(READERS))}")
    return READERS[extension]


def read(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    return reader_for(path)(spark, path, names)


def numbered(df: DataFrame, folder: str, first: int = 2, name: str = "row_num") -> DataFrame:
    """Row numbers in the order of df, the header being row 1.

    df is written to folder, file by file in its order; a row's number is its place in its file
    and the rows of the files before, which are counted, a row for each file.
    """
    df.write.parquet(folder)
    placed = df.sparkSession.read.schema(df.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg(F.count("*").alias("__n"))
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).cast("long")
    before = F.sum("__n").over(Window.orderBy(number, "__file")) - F.col("__n")
    files = files.select("__file", before.alias("__before"))
    return placed.join(files, "__file").select(*df.columns, (F.col("__before") + F.col("__row") + first).alias(name))


def stamped(df: DataFrame, job_id: str, sheet: str | None = None) -> DataFrame:
    return df.withColumns({"job_id": F.lit(job_id), "record_id": F.uuid(), "sheet_name": F.lit(sheet), "loaded_at": F.current_timestamp()})


def under_limit(df: DataFrame, most: int) -> bool:
    """Whether there are at most so many rows; reading stops when that is known."""
    return df.limit(most + 1).count() <= most
