"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns that
they were given. Stages define null, empty and repeated rows as their operators do.

Language ID rejects texts that are in none of the learned languages. Mixing keeps every row
and decides their order: its rows are written in it, and the last stage numbers its token
rows by it (`position`, from 0 without a gap).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, dart_minhash, language_id, mixing, stream_dedup
from keelson.llm.common import ended, materialise, table

#: A text with a smaller share of its letters in words familiar from training is rejected, as is one without letters.
MIN_FAMILIAR = 0.5
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs), MIN_FAMILIAR)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the files' order interleaved to the target weights."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token rows with their position in the mix, which is the order in which docs were written."""
    return bpe.digests_in_order(docs, RANKS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL has no conditional random field.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Token rows of all documents that stay, in the order of the mix.

    folder: where stages leave their rows, in a store that all executors share; a run that is
    started again with it goes on after the last stage that ended. Else they go to scratch.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        if folder and ended(spark, f"{folder}/{name}"):
            docs = spark.read.parquet(f"{folder}/{name}")
        else:
            docs = materialise(stage(spark, docs, sf_dir), name, f"{folder}/{name}" if folder else None)
    return STAGES[-1][1](spark, docs, sf_dir)
