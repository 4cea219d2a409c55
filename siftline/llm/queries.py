"""The queries op1 to op13, each applying one operator with production parameters to its whole table, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    ann, chat, clustering, mixing, neardup, packing, periods, quality, quantised, rules, sharding, substring, token_counts
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents"))


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_quality_rules,
        op5_minhash_neardup,
        op6_extendible_sharding,
        op7_substring_dedup,
        op8_chat_collapse,
        op9_learned_partitions,
        op10_source_mixing,
        op11_centroid_clustering,
        op12_periodic_runs,
        op13_embedding_neardup,
    )
}
#: None for tokenisers, trained models, random draws, approximate search and runs; tests hold those against brute force.
ORACLE_SQL = {
    "op4_quality_rules": rules.oracle(),
    "op5_minhash_neardup": neardup.oracle(),
    "op6_extendible_sharding": sharding.oracle(),
    "op7_substring_dedup": substring.oracle(),
    "op8_chat_collapse": chat.oracle(),
    "op11_centroid_clustering": clustering.oracle(),
    "op13_embedding_neardup": quantised.oracle(),
}
