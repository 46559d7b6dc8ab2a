"""Extraction over streams: sentences and mentions are stateless, counts keep state under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH, Pack
from graphloom.operators import relations
from graphloom.operators.mentions import with_mentions
from graphloom.operators.preprocess import split_sentences


def stream_sentences(docs: DataFrame, pack: Pack = ZH) -> DataFrame:
    """Sentences of a stream of documents; no running chapter, so chapter is empty."""
    each = docs.select("doc_id", F.posexplode(split_sentences(F.col("text"), pack)).alias("sentence_id", "text"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    return each.withColumns({"chapter": F.lit(""), "section": F.lit(""), "paragraph_id": F.lit(0)})


def stream_candidates(docs: DataFrame, vocabulary: DataFrame, pack: Pack = ZH) -> DataFrame:
    """Mention pairs with their gap, for a micro-batch sink that scores and merges them."""
    return relations.mention_pairs(with_mentions(stream_sentences(docs, pack), vocabulary, pack), pack)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of a key in tumbling (or sliding) windows, with rows later than `late` left out."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return events.withWatermark(time_col, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def merge_into(path: str):
    """A foreachBatch function that merges each micro-batch of candidates (of trigger_triples and the like) and appends its edges under path."""
    from graphloom.operators.merge import merge_triples

    def run(batch: DataFrame, batch_id: int) -> None:
        merge_triples(batch).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    return run
