"""What a staged table leaves on disk."""

import glob
import os
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from recordgate.llm import near_duplicates, shared, source_mixing, token_store
from recordgate.llm.queries import tokenizer_path

from ..conftest import SF


def shuffle_files(spark):
    """Shuffle files of the session's executor, which runs in the driver here."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in list(folders) for f in glob.glob(os.path.join(d, "**", "shuffle_*"), recursive=True)}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(100_000, numPartitions=4).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    made = shared.staged(rows, "freed")
    assert made.agg(F.sum("n")).first()[0] == 100_000 and spark.conf.get(shared._FREED) == "false"
    joined = shared.staged(made.join(rows.withColumnRenamed("n", "m"), "k").repartition(3, "k"), "freed-again")
    time.sleep(1)  # files go in the background
    assert not {f for f in shuffle_files(spark) - before if os.path.getsize(f) > 5000}
    assert joined.count() == 1000 and rows.count() == 1000


def test_a_filter_loses_no_key_and_lets_few_others_pass(spark):
    keys = spark.range(0, 20_000, 2, numPartitions=3).withColumn("k", F.xxhash64("id"))
    held = shared.key_filter(keys, "k")
    got = spark.range(20_000).where(held(F.xxhash64("id"))).agg(F.count_if(F.col("id") % 2 == 0), F.count_if(F.col("id") % 2 == 1)).first()
    assert got[0] == 10_000 and got[1] < 1000
    assert spark.range(100).where(shared.key_filter(keys.limit(0), "k")(F.xxhash64("id"))).count() == 0


def test_kinds_of_keys_are_right_or_left_open(spark):
    keys = spark.range(20_000, numPartitions=3).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 100 == 0, 7).otherwise(F.col("id") % 3).cast("int").alias("kind"), "id")
    keys = keys.unionByName(keys.where("id = 5").withColumn("kind", F.lit(1)))
    told = shared.key_kinds(keys, "k", "kind")
    got = keys.withColumn("told", told(F.col("k"))).agg(F.count_if(F.col("told") != F.col("kind")), F.count_if(F.col("told").isNull()), F.count_if((F.col("id") == 5) & F.col("told").isNull())).first()
    assert got[0] == 0 and got[1] < 1000 and got[2] == 2
    assert spark.range(5).where(shared.key_kinds(keys.limit(0), "k", "kind")(F.col("id")).isNotNull()).count() == 0


def test_tables_on_the_way_go_with_their_result(spark):
    kept = shared.staged(spark.range(10), "kept")
    result = shared.staged_alone(lambda: shared.staged(spark.range(5), "on-the-way").withColumn("n", F.col("id") + 1), "result")
    folders = os.listdir(shared.shared_folder(spark).removeprefix("file:") + "/staged")
    assert not [f for f in folders if f.startswith("on-the-way")]
    assert sorted(r["n"] for r in result.collect()) == [1, 2, 3, 4, 5] and kept.count() == 10


def test_untouched_documents_are_not_shuffled(spark):
    """Texts without a near duplicate stay where they are: what is shuffled is small beside them."""
    docs = spark.range(3000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f" {k}")), 256) for k in range(12)]).alias("text"))
    docs = shared.staged(docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)), "docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        left, before = near_duplicates.without_near_duplicates(docs), shuffle_files(spark)
        assert left.select("doc_id", F.length("text")).agg(F.count("*"), F.max("doc_id"), F.sum("length(text)")).first()[:2] == (3000, 2999)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(os.path.getsize(f) for f in shuffle_files(spark) - before) < 700_000  # of 2.3 MB of text


def test_mixed_documents_are_not_shuffled(spark):
    """Copies are told where the texts lie, in the same numbers as the plan has them."""
    docs = spark.range(3000, numPartitions=4).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f" {k}")), 256) for k in range(12)]).alias("text"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("source"),
    )
    docs = shared.staged(docs.unionByName(docs.where("doc_id < 20")), "docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for plans too large for it
    try:
        mixed, before = source_mixing.mixed_documents(docs), shuffle_files(spark)
        got = Counter(r["doc_id"] for r in mixed.select("doc_id", F.length("text")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(os.path.getsize(f) for f in shuffle_files(spark) - before) < 400_000  # of 2.3 MB of text
    want = source_mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert got == {r["doc_id"]: r["n"] for r in want} and len(set(got.values())) > 2


def batch_bytes(docs):
    """Bytes of the largest Arrow batch that a map over docs gets."""
    return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").agg(F.max("n")).first()[0]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """By bytes, in the pipeline and in the token store, and not after these."""
    docs = shared.staged(spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 4000).alias("text")), "long-texts")
    whole = batch_bytes(docs)
    assert whole > 3 * shared.BATCH
    with shared.small_batches(spark):
        assert batch_bytes(docs) < 1.5 * shared.BATCH
    assert batch_bytes(docs) == whole and shared._BATCHES not in spark.conf.getAll
    seen = []
    monkeypatch.setattr(token_store, "staged", lambda df, name: seen.append(spark.conf.get(shared._BATCHES)) or shared.staged(df, name))
    assert token_store.token_digest(docs, tokenizer_path()).count() == 4000 and seen == [str(shared.BATCH)]
    monkeypatch.setattr(corpus_pipeline.toxicity, "clean_documents", lambda docs, *_: docs)
    try:
        assert batch_bytes(corpus_pipeline.drop_toxic(spark, docs, SF)) < 1.5 * shared.BATCH
    finally:
        spark.conf.unset(shared._BATCHES)
