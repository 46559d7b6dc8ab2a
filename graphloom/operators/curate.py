"""Curation of dictionary and gold set."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.pack import ZH, Pack
from graphloom.functions.text import strip
from graphloom.sources.shared import written

KEY = ["head", "relation", "tail"]
# What counts as a value or a number in names.
VALUE_LIKE = r"%|倍|m/s|N·m|N/m|km/h|kg|m\^2|°|/"
NUMBERISH = r"^\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?\s*(?:%|°C?|度|km/h|m/s|km|kg|kw|kW|t|g|m|cm|mm|s|ms|kn|N·m|Nm|N|Mach|马赫|公里|米|秒|克|吨|公斤|赫兹|Hz|分钟|小时|h|次|步|倍|万|气|时)?$"
YEAR = r"^(?:19|20)\d{2}(?:年|s|年代)?$"


def numberish(c: Column) -> Column:
    return c.rlike(NUMBERISH) | c.rlike(YEAR)


def substrings(names: DataFrame, column: str, longest: int) -> DataFrame:
    """Each name with its substrings of up to `longest` characters: (column, part)."""
    n = F.explode(F.sequence(F.lit(1), F.least(F.length(column), F.lit(longest)))).alias("n")
    sized = names.where((F.length(column) > 0) & (F.lit(longest) > 0)).select(column, n)
    return sized.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.length(column) - F.col("n") + 1), lambda i: F.substring(F.col(column), i, F.col("n")))).alias("part"))


def align_gold(gold: DataFrame, pred: DataFrame, least: int = 2) -> DataFrame:
    """Gold rows rewritten to the predicted row of the same relation whose ends their own ends hold: an exact one, else the one of largest product of lengths (ties: smallest); others stay. Distinct."""
    g = gold.select(*KEY).distinct()
    p = pred.select(F.col("head").alias("p_head"), "relation", F.col("tail").alias("p_tail")).distinct()
    exact = (F.col("head") == F.col("p_head")) & (F.col("tail") == F.col("p_tail"))
    # Names within names meet by equality of substrings, of the distinct names alone.
    names = g.select(F.explode(F.array("head", "tail")).alias("whole")).distinct()
    inner = p.select(F.explode(F.array("p_head", "p_tail")).alias("part")).distinct().where(F.length("part") >= least)
    longest = inner.agg(F.max(F.length("part")).alias("n")).first()["n"] or 0
    held = substrings(names, "whole", longest).join(inner, "part").distinct()
    of = lambda end: held.select(F.col("whole").alias(end), F.col("part").alias(f"p_{end}"))
    hits = g.join(of("head"), "head").join(p, ["relation", "p_head"]).join(of("tail"), ["tail", "p_tail"])
    hits = hits.unionByName(g.join(p, (g["relation"] == p["relation"]) & exact).select(g["head"], g["relation"], g["tail"], "p_head", "p_tail"))
    rank = F.struct((~exact).alias("x"), (-F.length("p_head") * F.length("p_tail")).alias("n"), "p_head", "p_tail")
    best = hits.groupBy(*KEY).agg(F.min(rank).alias("b"))
    return g.join(best, KEY, "left").select(F.coalesce("b.p_head", "head").alias("head"), "relation", F.coalesce("b.p_tail", "tail").alias("tail")).distinct()


def garbage_head(h: Column, t: Column, least: int = 2, most: int = 12) -> Column:
    return (h == "") | (F.length(h) < least) | (F.length(h) >= most) | h.rlike(r"(?U)^\d") | h.rlike(VALUE_LIKE) | F.contains(h, F.lit("_")) | (h == t)


def augment_gold(gold: DataFrame, pred: DataFrame, relation: str = "instance_of") -> DataFrame:
    """Gold with the predicted rows of a relation that it lacks, except garbage heads and heads that gold gives another type."""
    new = pred.where(F.col("relation") == relation).select(*KEY).distinct().join(gold.select(*KEY), KEY, "left_anti")
    new = new.where(~garbage_head(F.trim("head"), F.trim("tail")))
    typed = gold.where(F.col("relation") == relation).select("head").distinct()
    return gold.select(*KEY).unionByName(new.join(typed, "head", "left_anti").select(*KEY))


def error_buckets(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """outcome, bucket, n. Missed rows by which ends are predicted at all (A both, B head, C tail, D none); wrong rows by numbers and gold ends (A head is a number, B a part that is a number, C both ends in gold, D one, E none)."""
    from graphloom.operators.evaluate import ends, marked

    rows = marked(pred, gold, KEY).where("outcome <> 'tp'")
    for name, side in (("p", pred), ("g", gold)):
        e = ends(side)
        for end in ("head", "tail"):
            rows = rows.join(e.select(F.col("entity").alias(end), F.lit(True).alias(f"{name}_{end}")), end, "left").withColumn(f"{name}_{end}", F.coalesce(f"{name}_{end}", F.lit(False)))
    missed = F.when(F.col("p_head") & F.col("p_tail"), "A").when(F.col("p_head"), "B").when(F.col("p_tail"), "C").otherwise("D")
    wrong = F.when(numberish(F.col("head")), "A").when(numberish(F.col("tail")) & (F.col("relation") == "has_part"), "B").when(F.col("g_head") & F.col("g_tail"), "C").when(F.col("g_head") | F.col("g_tail"), "D").otherwise("E")
    return rows.withColumn("bucket", F.when(F.col("outcome") == "fn", missed).otherwise(wrong)).groupBy("outcome", "bucket").agg(F.count("*").alias("n"))


def guess_type(c: Column, pack: Pack = ZH) -> Column:
    """Type of a term by the first of the pack's patterns that it holds; CONCEPT without one, `_DROP_` for quantities."""
    return reduce(lambda out, x: F.when(c.rlike(x[1]), x[0]).otherwise(out), reversed(pack.type_guesses), F.lit("CONCEPT"))


def suggest_terms(gold: DataFrame, vocabulary: DataFrame, gold_types: DataFrame | None = None, guess: Column | None = None, examples: int = 3) -> DataFrame:
    """Gold entities that the dictionary lacks, numbers aside: term, etype (gold's, else a guess over `term`, by default guess_type; those that it drops go), and up to `examples` gold rows."""
    each = gold.select(F.explode(F.array("head", "tail")).alias("term"), F.concat_ws(" ", *KEY).alias("row"))
    new = each.join(vocabulary.select("term").distinct(), "term", "left_anti").where(~numberish(F.col("term"))).distinct()
    w = W.partitionBy("term").orderBy("row")
    few = new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= examples).groupBy("term").agg(F.sort_array(F.collect_list("row")).alias("examples"))
    other = guess if guess is not None else guess_type(F.col("term"))
    told = gold_types.groupBy(F.col("entity").alias("term")).agg(F.min("type").alias("t")) if gold_types is not None else few.select("term", F.lit(None).cast("string").alias("t"))
    return few.join(told, "term", "left").select("term", F.coalesce("t", other).alias("etype"), "examples").where("etype <> '_DROP_'")


def merge_terms(vocabulary: DataFrame, more: DataFrame) -> DataFrame:
    """(term, etype): additions that no type has yet, the first type of each."""
    new = more.groupBy("term").agg(F.min("etype").alias("etype")).join(vocabulary.select("term"), "term", "left_anti")
    return vocabulary.select("term", "etype").unionByName(new.select("term", "etype"))


def prune_long_terms(vocabulary: DataFrame, long: int = 8, keep_types: tuple[str, ...] = (), keep_terms: tuple[str, ...] = ()) -> DataFrame:
    """Without terms of `long` characters or more that hold a term of 2 to long - 1 characters that doesn't begin with an ASCII letter or digit. Substrings of long terms meet short terms by equality, so there is no join on containment."""
    short = vocabulary.where(F.length("term").between(2, long - 1) & ~F.col("term").rlike("^[A-Za-z0-9]")).select("term").distinct()
    at_risk = vocabulary.where((F.length("term") >= long) & ~F.col("etype").isin(list(keep_types)) & ~F.col("term").isin(list(keep_terms))).select("term").distinct()
    sizes = F.explode(F.sequence(F.lit(2), F.lit(long - 1)))
    parts = at_risk.select(F.col("term").alias("whole"), sizes.alias("n")).select("whole", "n", F.explode(F.sequence(F.lit(1), F.length("whole") - F.col("n") + 1)).alias("i"))
    gone = parts.select("whole", F.substring("whole", F.col("i"), F.col("n")).alias("term")).join(short, "term", "left_semi").select(F.col("whole").alias("term")).distinct()
    return vocabulary.join(gone, "term", "left_anti")


def audit_terms(vocabulary: DataFrame, drop: DataFrame, retype: DataFrame) -> DataFrame:
    """Without dropped terms; with corrected types (retype: term, new_type)."""
    return vocabulary.join(drop.select("term").distinct(), "term", "left_anti").join(retype.select("term", "new_type"), "term", "left").select("term", F.coalesce("new_type", "etype").alias("etype")).distinct()


def valid_new_terms(proposed: DataFrame, vocabulary: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Proposals (term, etype, text) of a known type that the text holds, that aren't garbage, and are new; one row each."""
    ok = proposed.where(F.col("etype").isin(list(types)) & F.contains("text", F.col("term")) & ~garbage_head(F.trim("term"), F.lit("")))
    return ok.groupBy("term").agg(F.min("etype").alias("etype")).join(vocabulary.select("term"), "term", "left_anti")


def discovered(proposed: DataFrame, known: DataFrame, allowed: tuple[str, ...], most: int | None = None) -> DataFrame:
    """Proposed triples (with text) that are valid: two characters or more, different ends, both in the text, an allowed relation, not known; per text the first `most` by key."""
    ok = (F.length("head") >= 2) & (F.length("tail") >= 2) & (F.col("head") != F.col("tail")) & F.contains("text", F.col("head")) & F.contains("text", F.col("tail")) & F.col("relation").isin(list(allowed))
    rows = proposed.where(ok).select(*KEY, "text").distinct().join(known.select(*KEY), KEY, "left_anti")
    if most is None:
        return rows
    return rows.withColumn("n", F.row_number().over(W.partitionBy("text").orderBy(*KEY))).where(F.col("n") <= most).drop("n")


REPLY = "kept array<struct<head:string,relation:string,tail:string,score:double>>, added array<struct<head:string,relation:string,tail:string,score:double>>"


def reply_triples(replies: DataFrame) -> DataFrame:
    """Edges of a service's replies (reply: text; chapter, sentence of its batch): objects `kept` and `added`, stripped, without empty or equal ends, the first of equal keys of a reply; scores 0.7 by default, within 0 and 1."""
    parsed = replies.withColumn("row_", F.monotonically_increasing_id()).withColumn("r", lenient_json(F.col("reply"), REPLY))
    source = lambda c, name: F.transform(F.coalesce(F.col(f"r.{c}"), F.from_json(F.lit("[]"), "array<struct<head:string,relation:string,tail:string,score:double>>")), lambda x: F.struct(x.alias("t"), F.lit(name).alias("source")))
    each = parsed.select("row_", "chapter", "sentence", F.posexplode(F.concat(source("kept", "trigger+llm"), source("added", "llm"))).alias("k", "x"))
    rows = each.select("row_", "k", *(strip(F.coalesce(f"x.t.{c}", F.lit(""))).alias(c) for c in KEY), F.lit("llm").alias("trigger"), "x.source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.t.score", F.lit(0.7)))).alias("score"), "chapter", "sentence")
    ok = rows.where("head <> '' and relation <> '' and tail <> '' and head <> tail")
    return ok.withColumn("n", F.row_number().over(W.partitionBy("row_", *KEY).orderBy("k"))).where("n = 1").drop("n", "row_", "k")


def enhanced(edges: DataFrame, client: Callable[[str, list[dict]], str] | None = None, sentences: DataFrame | None = None, batch: int = 50, most_chars: int = 16_000) -> DataFrame:
    """Edges as a client keeps and adds them, a chapter at a time; without one, polished as they are.

    Chapters' edges go in batches of `batch` (by key), each with the first most_chars characters of the chapter's
    sentences; client(text, edges) gives a reply as reply_triples() reads it. A batch whose call fails, or whose reply
    holds no valid triple, stays as it was. Batches are rows, so a large chapter is many tasks.
    """
    from graphloom.operators.merge import merge_triples, polished

    if client is None:
        return polished(edges)
    fields = [*KEY, "trigger", "source", "score", "chapter", "sentence"]
    # Batches of a chapter by hash: about `batch` each, with no window over a whole chapter.
    size = edges.groupBy("chapter").agg(F.ceil(F.count("*") / batch).alias("parts"))
    placed = edges.select(*fields).join(size, "chapter").withColumn("part", F.pmod(F.xxhash64(*KEY), F.col("parts")))
    batches = placed.groupBy("chapter", "part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    if sentences is not None:
        text = sentences.groupBy("chapter").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), "\n"), 1, most_chars).alias("text"))
        batches = batches.join(text, "chapter", "left")
    else:
        batches = batches.withColumn("text", F.lit(""))

    @F.pandas_udf("string")
    def call(texts: pd.Series, rows: pd.Series) -> pd.Series:
        def one(text, some) -> str | None:
            try:
                return client(text or "", [dict(r) for r in some])
            except Exception:  # a failing service changes nothing
                return None

        return pd.Series([one(*x) for x in zip(texts, rows)], dtype=object)

    # Called once: what the service said is a table before it is read twice.
    said = written(batches.withColumn("reply", call("text", "rows")).withColumn("id_", F.xxhash64("chapter", "part")), "replies")
    first = F.get("rows", F.lit(0))
    told = reply_triples(said.select("id_", "reply", first["chapter"].alias("chapter"), first["sentence"].alias("sentence")).withColumn("sentence", F.concat(F.col("id_").cast("string"), F.lit("|"), "sentence")))
    told = told.withColumns({"id_": F.substring_index("sentence", "|", 1).cast("long"), "sentence": F.expr("substring(sentence, instr(sentence, '|') + 1)")})
    silent = said.join(told.select("id_").distinct(), "id_", "left_anti").select(F.explode("rows").alias("r")).select("r.*").select(*fields)
    both = told.select(*fields).unionByName(silent).withColumns({"stage": F.lit(0), "sentence_id": F.lit(0), "ord": F.xxhash64(*KEY, "source")})
    return merge_triples(both)


def discover(chapters: DataFrame, edges: DataFrame, client: Callable[[str, str, list[dict]], list[dict]], allowed: tuple[str, ...], most_new: int = 40, most_known: int = 60, most_chars: int = 16_000, least_chars: int = 40) -> DataFrame:
    """New triples that a client proposes for each chapter (chapter, text) of least_chars characters at least, told most_known known edges: those that discovered() finds valid, most_new a chapter at most. A failing call proposes nothing."""
    known = edges.select("chapter", *KEY).distinct().withColumn("n", F.row_number().over(W.partitionBy("chapter").orderBy(*KEY))).where(F.col("n") <= most_known)
    listed = known.groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("known"))
    asked = chapters.select("chapter", F.substring(strip(F.coalesce("text", F.lit(""))), 1, most_chars).alias("text")).where(F.length("text") >= least_chars).join(listed, "chapter", "left")

    @F.pandas_udf("array<struct<head:string,relation:string,tail:string>>")
    def call(texts: pd.Series, names: pd.Series, rows: pd.Series) -> pd.Series:
        def one(text, chapter, some) -> list[dict]:
            try:
                found = client(text, chapter, [dict(r) for r in (some if some is not None else ())])
                return [{c: str(x.get(c) or "").strip() for c in KEY} for x in found]
            except Exception:
                return []

        return pd.Series([one(*x) for x in zip(texts, names, rows)], dtype=object)

    proposed = asked.select("text", F.explode(call("text", "chapter", "known")).alias("t")).select("text", "t.*")
    return discovered(proposed, edges, allowed, most_new)


def lenient_json(c: Column, schema: str) -> Column:
    """The first {…} of a reply, code fences or not, parsed."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)
