"""A training corpus in five stages, each calling one operator of recordgate.llm.

Stages take (spark, docs, sf_dir) and return what the next stage gets as docs, with the
columns of documents; the last returns the description of the token store it wrote.
What a stage returns is run later, so a stage bounds the bytes of Arrow batches for the session; run() takes that back.
Labels, quality labels and the benchmark come from the tables beside documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordgate.llm import decontamination, near_duplicates, shared, source_mixing, token_store, toxicity
from recordgate.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels outside the held-out third."""
    shared.bound_batches(spark)
    return toxicity.clean_documents(docs, docs, shared.load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    shared.bound_batches(spark)
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    shared.bound_batches(spark)
    return decontamination.clean_documents(docs, shared.load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    shared.bound_batches(spark)
    return source_mixing.mixed_documents(docs, source_mixing.label_quality(shared.load(spark, sf_dir, "labels")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document in the token store: doc_id, start, n_tokens, ids_crc32."""
    shared.bound_batches(spark)
    return token_store.token_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_store", write_tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again as the next one's documents."""
    docs = shared.load(spark, sf_dir, "documents")
    with shared.small_batches(spark):
        for name, stage in STAGES:
            docs = shared.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
