"""The queries of this subpackage, each a thin layer over its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_roles import chat_turns, fit_roles, transcripts
from .conversation_trie import conversation_trie, trie_sql
from .decontamination import flagged
from .license_scan import license_scan, license_sql
from .shared import load
from .simhash_dedup import simhash_groups
from .source_mixing import label_quality, mix, mixing_sql
from .substring_dedup import substring_dedup, substring_sql
from .suffix_dedup import suffix_dedup, suffix_sql
from .token_alignment import alignment
from .token_store import token_digest
from .topk_search import top_k, top_k_sql
from .toxicity import toxicity
from .vector_search import nearest, nearest_sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents"), width=200).drop("kept")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity(docs, docs, load(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"), width=20).drop("kept")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(load(spark, sf_dir, "documents"), width=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(load(spark, sf_dir, "documents"), label_quality(load(spark, sf_dir, "labels")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(load(spark, sf_dir, "documents"), tokenizer_path(), end=2)


def op9_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts(load(spark, sf_dir, "conversations"))
    return chat_turns(rows, fit_roles(rows))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(load(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(load(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_vector_search, op3_toxicity, op4_decontamination, op5_substring_dedup,
        op6_simhash_dedup, op7_source_mixing, op8_token_store, op9_chat_roles, op10_license_scan,
        op11_conversation_trie, op12_token_alignment, op13_topk_search,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_sql(), "op2_vector_search": nearest_sql(), "op5_substring_dedup": substring_sql(), "op7_source_mixing": mixing_sql(), "op10_license_scan": license_sql(), "op11_conversation_trie": trie_sql(), "op13_topk_search": top_k_sql(),
}
