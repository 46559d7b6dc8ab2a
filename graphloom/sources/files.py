"""Readers and writers of texts, dictionaries, triples and results. Paths may be of any store that Spark reads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.pack import ZH, Pack
from graphloom.functions.text import score_of, strip
from graphloom.sources.shared import enough_partitions, written

ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030")
COLUMNS = {"head": ("head", "头实体", "source", "h"), "relation": ("relation", "关系", "type", "r"), "tail": ("tail", "尾实体", "target", "t")}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path) and text of whole files, in the first encoding that fits."""
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for e in ENCODINGS:
                try:
                    return b.decode(e).removeprefix("﻿")
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", "replace")

        return raw.map(one)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), decode("content").alias("text"))


def usable_terms(vocabulary: DataFrame, pack: Pack = ZH) -> DataFrame:
    """Without excluded types, stop terms, terms under two characters and plain numbers."""
    t = vocabulary.withColumn("term", strip(F.col("term")))
    return t.where((F.length("term") >= 2) & ~F.col("etype").isin(list(pack.excluded_types)) & ~F.col("term").isin(list(pack.stop_terms)) & ~F.regexp_replace("term", "[.%]", "").rlike(r"(?U)^\d+$"))


def read_vocabulary(spark: SparkSession, path: str, pack: Pack = ZH) -> DataFrame:
    """(term, etype, etype_ord, term_ord) of a JSON object type -> [terms], usable ones only, in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "map<string,array<string>>")
    types = whole.select(F.posexplode(F.map_entries(listed)).alias("etype_ord", "e")).select("etype_ord", F.col("e.key").alias("etype"), F.posexplode("e.value").alias("term_ord", "term"))
    return usable_terms(types.select("term", "etype", "etype_ord", "term_ord"), pack)


def vocabulary_of(spark: SparkSession, types: dict[str, list[str]], pack: Pack = ZH) -> DataFrame:
    rows = [(t, k, i, j) for i, (k, ts) in enumerate(types.items()) for j, t in enumerate(ts)]
    return usable_terms(spark.createDataFrame(rows, "term string, etype string, etype_ord int, term_ord int"), pack)


def first_types(vocabulary: DataFrame) -> DataFrame:
    """(term, etype): the first type of each term."""
    return vocabulary.groupBy("term").agg(F.min_by("etype", F.struct("etype_ord", "term_ord")).alias("etype"))


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(strip(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def read_triples(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """head, relation, tail, trigger, source, score, chapter, sentence of a CSV file with a header (BOM or not); several names for the ends; missing columns are empty, bad scores 1.0; with drop_invalid without empty or equal ends. Nothing is deduplicated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rest = {c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("") for c in ("trigger", "source", "chapter", "sentence")}
    score = score_of(F.col("score")) if "score" in raw.columns else F.lit(1.0)
    out = raw.select(*(_first(raw, names).alias(c) for c, names in COLUMNS.items()), rest["trigger"].alias("trigger"), rest["source"].alias("source"), score.alias("score"), rest["chapter"].alias("chapter"), rest["sentence"].alias("sentence"))
    return out.where("head <> '' and relation <> '' and tail <> '' and head <> tail") if drop_invalid else out


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(entity, type) of a CSV file, or with `lines` each line as an entity."""
    if lines:
        return spark.read.text(path).select(strip(F.col("value")).alias("entity"), F.lit("").alias("type")).where("entity <> ''").distinct()
    raw = spark.read.option("header", True).csv(path)
    return raw.select(_first(raw, ("entity", "实体")).alias("entity"), _first(raw, ("type", "类型")).alias("type")).where("entity <> ''").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a JSON object canonical -> [aliases]."""
    from graphloom.operators.evaluate import first_aliases

    names = F.expr("map_filter(from_json(value, 'map<string,string>'), (k, v) -> not startswith(k, '_'))")
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(names)).alias("o", "e"))
    rows = each.select("o", F.col("e.key").alias("canonical"), F.posexplode_outer(F.from_json("e.value", "array<string>")).alias("k", "alias"))
    return first_aliases(rows.select("canonical", F.coalesce("alias", F.lit("")).alias("alias"), (F.col("o") * 10_000 + F.coalesce("k", F.lit(0))).alias("ord")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments (#)."""
    return spark.read.text(path).select(strip(F.col("value")).alias("question")).where("question <> '' and not startswith(question, '#')")


def write_csv(df: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """Rows in order, with header; range-partitioned files unless a single one is asked for."""
    _sorted_csv(written(df, "unsorted"), path, order, single)


def _sorted_csv(table: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """write_csv of a table that is stored (ranges are found by a first pass over it, and its size is known). For a single file parts are sorted by as many tasks, and one task only copies them."""
    out = table.repartitionByRange(enough_partitions(table), *order).sortWithinPartitions(*order)
    if single:
        out = out.persist(StorageLevel.DISK_ONLY)
        out.count()
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    if single:
        out.unpersist()


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """line, place (from 0) of a text file, read in parts: places within a block and lines of the blocks before."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # as many rows as blocks
    placed = lines.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy("id")))
    return placed.join(F.broadcast(before), "block").select("line", (F.col("before") + F.col("k") - 1).alias("place"))


def export_result(edges: DataFrame, folder: str) -> None:
    """triples, triples_meta (scores with 3 places), entities and statistics under folder."""
    from graphloom.operators.merge import entities, statistics

    order = ["head", "relation", "tail"]
    edges = written(edges, "edges")  # four files of them, sorted: found once
    _sorted_csv(edges.select(*order), f"{folder}/triples", order)
    meta = edges.select(*order, "trigger", "source", F.format_string("%.3f", "score").alias("score"), "chapter", "sentence")
    _sorted_csv(meta, f"{folder}/triples_meta", order)
    write_csv(entities(edges), f"{folder}/entities", ["entity"])
    write_csv(statistics(edges), f"{folder}/statistics", ["level", "source", "relation"], single=True)


def export_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """JSON object type -> [terms] in the vocabulary's order. The dictionary is one object, so one row."""
    terms = vocabulary.groupBy("etype").agg(F.min("etype_ord").alias("o"), F.sort_array(F.collect_list(F.struct("term_ord", "term"))).alias("t"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("o", "etype", F.transform("t", lambda x: x["term"]).alias("terms")))), lambda x: F.struct(x["etype"], x["terms"]))
    terms.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def pretty(vocabulary: DataFrame) -> str:
    rows = vocabulary.orderBy("etype_ord", "term_ord").select("etype", "term").collect()  # a dictionary for people
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["etype"], []).append(r["term"])
    return json.dumps(out, ensure_ascii=False, indent=2)
