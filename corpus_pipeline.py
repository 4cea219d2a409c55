"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of `documents`; the last gives
the pieces of `siftline.llm.packing` (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A document that
the mix takes twice has two rows from there on, and its pieces are packed twice.

Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and other columns are those of
the operators; the columns of `documents` come through the first four stages whatever their names.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import mixing, neardup, packing, rules, substring
from siftline.llm.common import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out of the texts."""
    return substring.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken in blocks up to their target weights."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", minhash_neardup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the tokeniser or the mix's random draws; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of `documents`, each written and read again, so none replays those before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return docs
