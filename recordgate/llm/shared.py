"""What the operators of this subpackage share: tables, staged results, text rules.

Rules that hold for every operator here:

* A null text counts as the empty text.
* Only the columns an operator needs are read; further columns of any name are
  carried along untouched or left out, as each operator says, and never clash
  with its own.
* Intermediate tables that are read more than once are written to the folder in
  ``spark.checkpoint.dir``, which driver and executors share, so a lost executor
  costs a re-read and not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and tasks run in the driver's process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a statement's shuffle files go when it ends; else they stay until the driver collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Statements run inside leave no shuffle files behind: for those whose result is written and whose plan is not run again."""
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


#: Bytes of an Arrow batch on its way to Python.  Spark's own bound is 10 000 rows, which is tens of MB of texts, held by the JVM
#: beside its heap, which keeps much of it, and again by Python.
BATCH = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Statements run inside send texts to Python by BATCH bytes, unless the session has a bound of its own."""
    own = spark.conf.getAll.get(_BATCHES)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.unset(_BATCHES) if own is None else spark.conf.set(_BATCHES, own)


def bound_batches(spark: SparkSession) -> None:
    """Sets that bound for the rest of the session, for results that are run later."""
    if spark.conf.getAll.get(_BATCHES) is None:
        spark.conf.set(_BATCHES, BATCH)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that were staged inside staged_alone(), if there is one.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, staged; the tables that were staged on the way to it are deleted then."""
    before = _PASSING.set([])
    try:
        df = make()
        passing = list(_PASSING.get())
    finally:
        _PASSING.reset(before)
    result = staged(df, name)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in passing:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return result


#: Keys of a filter per word of 64 bits, and words at most (32 MB): with more keys it lets more others pass.
FILTER_KEYS, FILTER_WORDS = 4, 1 << 22


def _word_and_mask(key: Column, words: int) -> tuple[Column, Column]:
    """Where a key's bits are in a filter of so many words: the word, and four bits of it."""
    h = F.xxhash64(key, F.lit("filter"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def key_filter(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for long keys: true for all of keys and for about one in thirty others, so few rows are left to shuffle for an exact join.

    It is a Bloom filter, made by an aggregation and sent to the tasks.
    """
    spark = keys.sparkSession
    n = max(1, keys.count())
    words = min(FILTER_WORDS, max(64, -(-n // FILTER_KEYS)))
    word, mask = _word_and_mask(F.col(column), words)
    table = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def held(word: pa.Array, mask: pa.Array) -> pa.Array:
        asked = mask.to_numpy(zero_copy_only=False)
        return pa.array(sent.value[word.to_numpy(zero_copy_only=False)] & asked == asked)

    return lambda key: held(*_word_and_mask(key, words))


def key_kinds(rows: DataFrame, key: str, kind: str) -> Callable[[Column], Column]:
    """The kind of a long key of rows, where no other kind is possible; null for about one key in thirty or fewer, and for keys of several kinds.

    Each kind (an int, of few) has a filter like key_filter()'s, and all of these together are as large as one.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(kind).count().toArrow()
    kinds = np.sort(counts.column(kind).to_numpy())
    n = sum(counts.column("count").to_pylist())
    words = max(64, min(FILTER_WORDS // max(1, len(kinds)), -(-n // (2 * FILTER_KEYS))))
    word, mask = _word_and_mask(F.col(key), words)
    table = rows.select(kind, word.alias("word"), mask.alias("mask")).groupBy(kind, "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros((len(kinds), words), np.int64)
    bits[np.searchsorted(kinds, table.column(kind).to_numpy()), table.column("word").to_numpy()] = table.column("mask").to_numpy()
    sent = spark.sparkContext.broadcast((kinds, bits))

    @F.arrow_udf("int")
    def only(word: pa.Array, mask: pa.Array) -> pa.Array:
        kinds, bits = sent.value
        at, asked = word.to_numpy(zero_copy_only=False), mask.to_numpy(zero_copy_only=False)
        found, times = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for own, value in zip(bits, kinds.tolist(), strict=True):
            held = own[at] & asked == asked
            found[held] = value
            times += held
        return pa.array(found, mask=times != 1)

    return lambda key: only(*_word_and_mask(key, words))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts_for(rows: int, per_part: int) -> int:
    """Groups so that each holds about per_part rows, however many rows there are."""
    return max(1, -(-rows // per_part))


def packed(docs: DataFrame, *more) -> DataFrame:
    """docs as one struct column ``row``, so that no name can clash with further columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def row_columns(docs: DataFrame) -> list:
    """The columns of docs, out of the ``row`` that packed() made."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]
