"""Keys of a very large table, ready for batch after batch: a table in buckets by key, and a Bloom filter in blocks.

Both are kept in tables that the catalog knows to be in buckets, so that a batch is dealt to them and they stay where they are.  A
batch first meets the filter, which is about a bit and a half for each key; keys that the filter lacks are new for
sure and go no further.  The others meet the keys themselves, so results are exact.  Filters are unions of bits: keys are added by adding blocks, and indexes are merged by
putting their blocks into one table.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block of the filter, which is what one bitmap function call covers.
BLOCK_BITS = 32_768
#: Bits for each expected key, and bits that a key sets: about one key in 60 that is not there passes.
BITS_PER_KEY, BITS_OF_KEY = 12, 4


@dataclass(frozen=True)
class KeyIndex:
    """An index called name with files in folder.  key: columns, found by these names in tables and batches alike.

    expected: about how many keys there will be; more are kept right but pass the filter more often.
    """

    spark: SparkSession
    name: str
    folder: str
    key: tuple[str, ...]
    expected: int
    buckets: int = 64

    @property
    def blocks(self) -> int:
        return max(1, -(-self.expected * BITS_PER_KEY // BLOCK_BITS))

    @property
    def keys_table(self) -> str:
        return f"{self.name}_keys"

    @property
    def filter_table(self) -> str:
        return f"{self.name}_filter"

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self.key)

    def _block(self) -> Column:
        return F.pmod(self._hash(0), F.lit(self.blocks)).cast("int")

    def _positions(self) -> list[Column]:
        """Bits of a key in its block: two hashes, added up."""
        one, other = self._hash(1), self._hash(2)
        return [F.pmod(F.shiftright(one, 1) + F.lit(i) * F.shiftright(other, 3), F.lit(BLOCK_BITS)).cast("int") for i in range(BITS_OF_KEY)]

    def _whole(self, df: DataFrame) -> DataFrame:
        """Rows whose key has no null: a null part equals nothing."""
        return df.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.key]))

    def add(self, facts: DataFrame) -> None:
        """Put the keys of facts in; keys that are there already may come again."""
        keys = self._whole(facts).select(*self.key).distinct()
        self._append(keys, self.keys_table, list(self.key))
        bits = keys.select(self._block().alias("block"), F.explode(F.array(*self._positions())).alias("at"))
        made = bits.groupBy("block").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
        self._append(made, self.filter_table, ["block"])

    def _append(self, df: DataFrame, table: str, by: list[str]) -> None:
        writer = df.repartition(self.buckets, *by).write.bucketBy(self.buckets, *by).sortBy(*by).mode("append").format("parquet")
        writer.option("path", f"{self.folder}/{table}").saveAsTable(table)

    def merge(self, other: KeyIndex) -> None:
        """Take over the keys of an index with as many blocks, made elsewhere or at another time."""
        if (other.blocks, other.key) != (self.blocks, self.key):
            raise ValueError("indexes of one size and key only can be merged")
        self._append(self.spark.table(other.keys_table), self.keys_table, list(self.key))
        self._append(self.spark.table(other.filter_table), self.filter_table, ["block"])

    def attach(self) -> None:
        """Name the tables to the catalog of a new session; files stay as they are."""
        keys = ", ".join(f"`{c}`" for c in self.key)
        for table, by in ((self.keys_table, keys), (self.filter_table, "block")):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.folder}/{table}").schema.fields)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{table}'")

    def possible(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose key the filter has: all whose key is in the index, and about one in 60 of the others."""
        octet = lambda bits, at: F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, 1)), 16, 10).cast("long")
        filters = self.spark.table(self.filter_table).select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
        asked = self._whole(batch).withColumn("__own", self._block()).withColumn("__at", F.array(*self._positions()))
        # A key was put in at once, so all of its bits are in one row, however many rows a block has by now.
        there = F.forall("__at", lambda at: F.getbit(octet(F.col("__bits"), at), at % 8) == 1)
        return asked.join(filters, (F.col("__own") == F.col("__block")) & there, "left_semi").select(*batch.columns)

    def existing(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose key is in the index: those that pass the filter and are among the keys, which are not dealt anew."""
        return self.possible(batch).join(self.spark.table(self.keys_table), list(self.key), "left_semi")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose key is not in the index, those with a null in their key among them."""
        keys = self.existing(batch.select(*self.key).distinct())
        return batch.join(keys, list(self.key), "left_anti")
