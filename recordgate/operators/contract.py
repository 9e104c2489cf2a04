"""Contracts of tables: required and allowed columns, their order, and checks of every cell in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

CONTRACT = "dataset string, column string, position int, required boolean, max_length int, pattern string, kind string"


def contract_frame(spark: SparkSession, dataset: str, schema: T.StructType) -> DataFrame:
    """A row per column of a schema; metadata of its fields may give required, max_length, pattern, kind."""
    rows = [
        (dataset, f.name, k + 1, bool(f.metadata.get("required", not f.nullable)), f.metadata.get("max_length"), f.metadata.get("pattern"),
         f.metadata.get("kind", f.dataType.simpleString()))
        for k, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, CONTRACT)


def missing_columns(contract: DataFrame, actual: DataFrame) -> DataFrame:
    return contract.where("required").join(actual.select("dataset", "column"), ["dataset", "column"], "left_anti").select("dataset", "column")


def unexpected_columns(contract: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.join(contract.select("dataset", "column"), ["dataset", "column"], "left_anti").select("dataset", "column")


def out_of_order(contract: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns that stand before one they should follow."""
    both = contract.select("dataset", "column", F.col("position").alias("expected")).join(
        actual.select("dataset", "column", F.col("position").alias("found")), ["dataset", "column"]
    )
    before = F.lag("found").over(Window.partitionBy("dataset").orderBy("expected"))
    return both.withColumn("before", before).where("before > found").select("dataset", "column", "expected", "found")


def cells(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form: keys, column, value; one pass, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("c")).select(*keys, "c.*")


def cell_errors(df: DataFrame, contract: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """First fault of every cell by its column's contract: required, length, pattern, type.

    The contract has a row for each column, so it goes to the cells: dealt by column these would be as many tasks as there are columns.
    """
    spec = contract.select("column", "required", "max_length", "pattern", "kind")
    joined = cells(df, keys, columns).join(F.broadcast(spec), "column")
    value = F.col("value")
    wrong_kind = F.coalesce(*[F.when(F.col("kind") == k, rules.not_convertible(value, k)) for k in ("int", "long", "double", "decimal", "boolean", "date")], F.lit(False))
    fault = (
        F.when(F.col("required") & rules.missing(value), "REQUIRED_MISSING")
        .when(rules.missing(value), None)
        .when(F.length(value) > F.col("max_length"), "FIELD_TOO_LONG")
        .when(~F.regexp(value, F.col("pattern")), "INVALID_PATTERN")
        .when(wrong_kind, "DATA_TYPE")
    )
    return joined.withColumn("error_type", fault).where("error_type is not null").select(*keys, "column", "value", "error_type")


def rows_from_cells(cell_table: DataFrame, names: list[str], header_row: int = 1) -> DataFrame:
    """(sheet, row_no, col, value) -> a record per row below the header row, a column per name; headers match by trimmed lower case."""
    headers = cell_table.where(F.col("row_no") == header_row).select("sheet", "col", F.lower(F.trim("value")).alias("header"))
    data = cell_table.where(F.col("row_no") > header_row).join(headers, ["sheet", "col"])
    return data.groupBy("sheet", "row_no").pivot("header", [n.lower() for n in names]).agg(F.first("value", ignorenulls=True))


def read_if_valid(spark: SparkSession, reader, path: str, contract: DataFrame, dataset: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows, faults): rows only if no required column is missing.  Columns of a table are few; their check is a small job."""
    df = reader(spark, path)
    actual = spark.createDataFrame([(dataset, c, k + 1) for k, c in enumerate(df.columns)], "dataset string, column string, position int")
    faults = missing_columns(contract, actual)
    return (None if faults.limit(1).count() else df), faults
