"""Merging candidate triples into edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.pack import NUMERIC_RELATIONS
from graphloom.functions.text import is_pure_number, strip
from graphloom.sources.shared import dealt

KEY = ["head", "relation", "tail"]


def valid_ends(triples: DataFrame) -> DataFrame:
    """Without empty or equal ends, numbers as heads, and numbers as tails of relations that take no number."""
    h, t = F.col("head"), F.col("tail")
    return triples.where((h != "") & (t != "") & (h != t) & ~is_pure_number(h) & (~is_pure_number(t) | F.col("relation").isin(list(NUMERIC_RELATIONS))))


def merge_triples(triples: DataFrame) -> DataFrame:
    """One row per (head, relation, tail), folded in the order of (stage, sentence_id, ord): a higher score replaces what was there; another source is appended to it, with the first non-empty trigger, chapter and sentence; the same source is ignored.

    The fold depends on order, but what counts is the first row with the best score, and after it the rows from the
    first of another source on. So windows over one sort by key and order (in partitions enough for the table) drop
    the others, and the rest is folded: its sources, in order.
    """
    fields = ["trigger", "source", "score", "chapter", "sentence"]
    t = dealt(valid_ends(triples).select(*KEY, *fields, "stage", "sentence_id", "ord"), *KEY)
    whole = W.partitionBy(*KEY)
    in_order = whole.orderBy("stage", "sentence_id", "ord", "source", "trigger", "sentence")
    top = t.withColumn("pos", F.row_number().over(in_order)).withColumn("top", F.max("score").over(whole))
    base = top.withColumn("base", F.min(F.when(F.col("score") == F.col("top"), F.struct("pos", "source"))).over(whole))
    other = (F.col("pos") > F.col("base.pos")) & ~F.coalesce(F.col("source") == F.col("base.source"), F.lit(False))
    after = base.withColumn("others", F.max(other).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("pos = base.pos or (pos > base.pos and others)")
    item = F.struct("pos", *fields)
    listed = after.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(*(F.element_at("items", 1)[f].alias(f) for f in fields))
    keep = lambda a, b: F.when(a != "", a).otherwise(b)
    step = lambda cur, x: F.when(x["source"] == cur["source"], cur).otherwise(F.struct(keep(cur["trigger"], x["trigger"]).alias("trigger"), F.concat_ws("+", cur["source"], x["source"]).alias("source"), cur["score"].alias("score"), keep(cur["chapter"], x["chapter"]).alias("chapter"), keep(cur["sentence"], x["sentence"]).alias("sentence")))
    folded = F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, step)
    return listed.select(*KEY, folded.alias("m")).select(*KEY, "m.*")


def ranked(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.desc("score"), "relation", "head", "tail")


def entities(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def polished(edges: DataFrame) -> DataFrame:
    """Ends stripped; without empty or equal ends; the first (best score) of equal keys."""
    t = edges.withColumns({c: strip(F.col(c)) for c in KEY}).where("head <> '' and tail <> '' and relation <> '' and head <> tail")
    return t.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("score"), "source"))).where("n = 1").drop("n")


def statistics(edges: DataFrame) -> DataFrame:
    """Counts in one pass: in all, by source, by relation."""
    return edges.groupingSets([[], ["source"], ["relation"]], "source", "relation").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
