"""Corpus pipeline: quality rules, near duplicates, repeated passages, source mix, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import bpe_transducer, jaccard_join, quality_rules, source_mix, suffix_trees
from wakeline.session import shared_folder


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the rules, or whose host does, go."""
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each class of documents with similar five-word shingles (0.8 or more), the smallest id stays."""
    return jaccard_join.keep_one_of_each_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of 20 words and more that an earlier document has are cut out of the texts."""
    return suffix_trees.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as many times as their source's target gives them copies."""
    return source_mix.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids of each text, and the digest of what they decode to."""
    return bpe_transducer.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", drop_low_quality), ("jaccard_join", drop_near_duplicates), ("suffix_trees", cut_repeats),
          ("source_mix", mix_sources), ("bpe", encode)]
ORACLE_SQL = None       # the dual of the mix and the merges of the vocabulary are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result but the last is written as Parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
