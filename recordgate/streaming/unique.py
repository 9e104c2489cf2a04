"""Uniqueness in a stream by keyed state: every row comes out again, marked as accepted or not.

The state store keeps one row for each key that was seen, on the disks of the executors and in the checkpoint, so what a
batch costs follows from the batch alone and not from what was accepted before it.  State is restored from
the checkpoint, also after a stop in the middle of a batch.

The state is asked from Python row by row, so rows that cannot be accepted don't go there: of the rows of one key that meet in an
Arrow batch all but the one of the least order.  They are carried past it as bytes, beside one of the rows that go there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Accepts one row of each key, ever (or within so many milliseconds): of those that come in one batch the one of the least order."""

    def __init__(self, columns: list[str], order: str, keep_ms: int | None = None):
        self.made, self.at, self.keep_ms = Row(*columns, "accepted"), columns.index(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms) if self.keep_ms else handle.getValueState("seen", "seen boolean")

    def _rank(self, row: Row) -> tuple:
        value = row[self.at]
        return (value is None, value)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None  # one row at a time is held, however many a key has
        known = self.seen.exists()
        for row in rows:
            if known:
                yield self.made(*row, False)
            elif best is None:
                best = row
            elif self._rank(row) < self._rank(best):
                yield self.made(*best, False)
                best = row
            else:
                yield self.made(*row, False)
        if best is not None:
            self.seen.update((True,))
            yield self.made(*best, True)

    def close(self) -> None:
        pass


#: The column of carried rows.
_CARRIED = "__carried rows"


def least_of_keys(batch: pa.RecordBatch, key: list[str], order: str) -> pa.Array:
    """For each row whether it may be the first of its key: not if the batch has another row of the key before it in order."""
    by = pa.table([*[batch.column(c) for c in key], batch.column(order)], [str(k) for k in range(len(key) + 1)])
    try:
        places = pc.sort_indices(by, [(c, "ascending") for c in by.column_names], null_placement="at_end")
        new = [pc.not_equal(c[1:], c[:-1]) for c in by.take(places).columns[:-1]]
    except pa.ArrowNotImplementedError:  # a type without an order in Arrow
        return pa.array([True] * batch.num_rows)
    first = pa.concat_arrays([pa.array([True]), *functools.reduce(pc.or_, new).chunks])
    return pc.is_in(pa.array(range(batch.num_rows), pa.uint64()), value_set=places.filter(first))


def _set_apart(key: list[str], order: str):
    """Rows that may be accepted; the first one of a batch carries the batch's others."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            open_rows = least_of_keys(batch, key, order)
            others, rows = batch.filter(pc.invert(open_rows)), batch.filter(open_rows)
            carried = [None] * rows.num_rows
            if others.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others.schema) as writer:
                    writer.write_batch(others)
                carried[0] = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(carried, pa.binary())], [*batch.schema.names, _CARRIED])

    return run


def _put_back(batches):
    """Rows with carried rows and accepted last -> all rows with accepted last."""
    for batch in batches:
        *columns, carried, accepted = batch.columns
        names = [*batch.schema.names[:-2], "accepted"]
        yield pa.RecordBatch.from_arrays([*columns, accepted], names)
        for octets in carried.drop_null().to_pylist():
            for others in pa.ipc.open_stream(octets):
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array([False] * others.num_rows)], names)


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in the store on disk, which keyed processors need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def marked(stream: DataFrame, key: list[str], order: str, keep_ms: int | None = None) -> DataFrame:
    """stream + accepted: whether the row is the first of its key; a row with a null in its key repeats nothing.

    keep_ms forgets a key so long after it was seen, which bounds the state of an endless stream.
    """
    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    flag, carried = T.StructField("accepted", T.BooleanType()), T.StructField(_CARRIED, T.BinaryType())
    fields = stream.schema.fields
    mode = "ProcessingTime" if keep_ms else "None"
    # Dealt by key first, so that rows of a key meet.
    met = stream.where(whole).repartition(*key).mapInArrow(_set_apart(key, order), T.StructType([*fields, carried]))
    keyed = met.groupBy(*key).transformWithState(FirstOfKey(met.columns, order, keep_ms), T.StructType([*fields, carried, flag]), "Append", mode)
    keyed = keyed.mapInArrow(_put_back, T.StructType([*fields, flag]))
    return keyed.unionByName(stream.where(~whole).withColumn("accepted", F.lit(True)))


def write_marked(rows: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Put all that is there through and stop; gives the progress of the batches that had rows.

    The sink's own log names the files of finished batches, so a batch that is run again leaves nothing twice.
    """
    with state_on_disk(rows.sparkSession):
        query = (
            rows.writeStream.format("parquet").partitionBy("accepted").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"] > 0]


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    """What write_marked() wrote; the mark is in the names of folders and comes back as a flag."""
    return spark.read.parquet(path).withColumn("accepted", F.col("accepted").cast("boolean"))
