"""Queries of the user's own formats: read in splits with pushed filters, and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contract
from ..sources import user_formats
from ..streaming import stream
from .file_queries import scratch
from .registry import TWIN_VIEWS, Source, query

TWIN_VIEWS["customer_rows"] = """SELECT 'S' || CAST(c_nationkey AS VARCHAR) AS sheet, CAST(c_custkey + 2 AS INT) AS row_no, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"""
_HEADERS = ["c_custkey", "c_name", "c_mktsegment"]


def customer_cells(t: Source) -> DataFrame:
    """A sheet for each nation, a row for each customer below the header row, in long form."""
    sheet = F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("sheet")
    cells = lambda values: F.explode(F.array(*[F.struct(F.lit(k).alias("col"), v.cast("string").alias("value")) for k, v in enumerate(values, 1)])).alias("c")
    heads = t.customer.select(sheet).distinct().select("sheet", F.lit(1).alias("row_no"), cells([F.lit(f" {h.upper()} ") for h in _HEADERS]))
    rows = t.customer.select(sheet, (F.col("c_custkey") + 2).cast("int").alias("row_no"), cells([F.col(h) for h in _HEADERS]))
    return heads.unionByName(rows).select("sheet", "row_no", "c.col", "c.value")


def write_cells(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Cells as lines, one each."""
    value = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n")
    line = F.concat_ws("\t", "sheet", "row_no", "col", F.coalesce(value, F.lit("\\N")))
    cells.select(line.alias("value")).write.mode(mode).text(path)


@query("SRC17", "SELECT * FROM customer_rows")
def src17(t):
    """A cell file in splits, several tasks at once, and its records."""
    path = scratch(t, "src17")
    write_cells(customer_cells(t), path)
    user_formats.register(t.spark)
    cells = t.spark.read.format("cells").option("split", 64 << 10).load(path)
    return contract.rows_from_cells(cells, _HEADERS)


@query("STR10", "SELECT * FROM customer_rows")
def str10(t):
    """The same as a stream: half of the sheets come, then the others."""
    folder = scratch(t, "str10")
    user_formats.register(t.spark)
    cells = customer_cells(t)
    for even in (True, False):
        part = F.pmod(F.substring("sheet", 2, 9).cast("int"), F.lit(2)) == (0 if even else 1)
        write_cells(cells.where(part), f"{folder}/in")
        came = t.spark.readStream.format("cells").load(f"{folder}/in")
        stream.run_batches(came, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    return contract.rows_from_cells(t.spark.read.parquet(f"{folder}/out").select("sheet", "row_no", "col", "value"), _HEADERS)


class TaggedOrders(user_formats.LineFormat):
    """A format as a user would write it: name=value pairs with semicolons between, in any order."""

    @classmethod
    def name(cls) -> str:
        return "tagged_orders"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_custkey", T.LongType())])

    def record(self, line: bytes) -> tuple | None:
        pairs = dict(p.split("=", 1) for p in line.decode().split(";") if "=" in p)
        number = lambda n: int(pairs[n]) if pairs.get(n, "").isdecimal() else None
        return (number("key"), pairs.get("status"), number("customer")) if "key" in pairs else None


@query("UDF06", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 10")
def udf06(t):
    path = scratch(t, "udf06")
    pair = lambda n, c: F.concat(F.lit(f"{n}="), F.col(c).cast("string"))
    t.orders.select(F.concat_ws(";", pair("status", "o_orderstatus"), pair("key", "o_orderkey"), pair("customer", "o_custkey")).alias("value")).write.text(path)
    user_formats.register(t.spark, TaggedOrders)
    rows = t.spark.read.format("tagged_orders").option("push", True).load(path)
    return rows.where((F.col("o_orderstatus") == "F") & (F.col("o_custkey") >= 10)).select("o_orderkey", "o_orderstatus")
