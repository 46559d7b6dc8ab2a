"""From raw documents to token shards: each stage keeps what the next one reads.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of docs, extra ones included, whatever their names. Null texts are empty ones, so they go with the
quality stage; an empty table gives an empty one in each stage. run() applies them to `documents`, with a Parquet table in the
shared folder between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import cut, table
from graphloom.llm.decontam import decontaminated
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.neardup import deduplicated
from graphloom.llm.quality import fit_quality, good_documents
from graphloom.llm.sstable import token_shards

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs, doesn't reject."""
    return good_documents(docs, fit_quality(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id. Distinct texts under one doc_id, or without any, are different documents; of rows that repeat both one stays; texts without words all stay."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of docs: doc_id, start, n_tokens, ids_crc32 of each row."""
    return token_shards(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL can't express trained models and tokenizers; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
