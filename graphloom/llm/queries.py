"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.sstable import token_shards

    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.repeats import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import render_chats

    return render_chats(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontam import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.langid import fit_crf, languages, training_spans

    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit_crf(training_spans(docs)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import fit_toxicity, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from graphloom.llm import chat, decontam, embeddings, neardup, repeats

    return {"op2_repeated_passages": repeats.SQL, "op3_embedding_dedup": embeddings.SQL, "op5_chat_format": chat.SQL, "op7_decontaminate": decontam.SQL, "op8_minhash_dedup": neardup.SQL}
