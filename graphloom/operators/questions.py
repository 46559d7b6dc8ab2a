"""Questions over graph and corpus: intents, entities, retrieval for a whole table of questions at once, answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.pack import ZH, Pack
from graphloom.functions.text import strip
from graphloom.operators import graph
from graphloom.operators.mentions import _occurrences, held_terms, matcher, shared_terms
from graphloom.sources.shared import written

# Relations that each intent looks up, how many rows it returns, and the words of answers.
PROPERTIES = ("has_part", "has_parameter", "has_performance", "has_configuration", "has_value", "has_property", "uses_material", "made_of")
CAUSES = ("causes", "reduces", "improves", "affects", "leads_to", "generates")
VALUES = ("has_value", "greater_than_value", "less_than_value", "equals_to", "approximately")
FALLBACKS = ("has_part", "used_for", "develops", "applied_to")
LIMITS = {"DEFINITION": 8, "LIST_INSTANCE": 15, "VALUE": 8, "CAUSE": 10, "EFFECT": 10, "LOCATION": 8, "CHAPTER": 8, "PROPERTY": 12, "RELATION": 15, "SUMMARY": 15, "NEIGHBOR": 12, "UNKNOWN": 12}
NO_TRIPLE, EVIDENCE = "（图谱中暂无直接三元组，请参考下方原文证据）", "原文佐证："
NOTHING = ("未在知识图谱与论文中找到与「", "」直接相关的内容。请尝试更换关键词，或在左侧切换为「全局浏览」模式查看可用实体。")
NO_ENTITY = "没有从问题中识别到任何领域实体。建议把要查的实体写明确，例如：「全球鹰 是多少」"
TRAILING, LEADING = "?？.。、!！,，;；:：", " 请问帮我"


def clean_question(c: Column) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, f"[{re.escape(TRAILING)}]+$", "")
    return strip(F.regexp_replace(c, f"^[{LEADING}]+", ""))


def intent(c: Column, pack: Pack = ZH) -> Column:
    """struct(intent, relation): of the first pattern, in order, that is found."""
    pick = lambda name, rel: F.struct(F.lit(name).alias("intent"), F.lit(rel).cast("string").alias("relation"))
    return reduce(lambda out, p: F.when(c.rlike(p[1]), pick(p[0], p[2])).otherwise(out), reversed(pack.intents), pick("UNKNOWN", None))


def _clean(q: str) -> str:
    return q.strip().rstrip(TRAILING).lstrip(LEADING).strip()


def parse_questions(questions: DataFrame, entities: DataFrame, pack: Pack = ZH) -> DataFrame:
    """With q (cleaned), intent, relation and entities: mentions in order, without repeats; before them, of each captured group in turn, its longest entity (ties: the smallest) that isn't there yet."""
    regexes = [re.compile(p) for _, p, _ in pack.intents]
    told = questions.withColumn("q", clean_question(F.col("question"))).withColumn("i", F.transform(F.array("q"), lambda q: intent(q, pack))[0]).select("*", "i.*").drop("i")

    def entities_of(q: str, places) -> list[str]:
        hit = next((m for m in (r.search(q) for r in regexes) if m), None)
        text = "\n".join(_clean(g) for g in hit.groups() if g and g not in "?？") if hit else ""
        inside = matcher(places, pack, numeric=False, codes=False, dedup=False)(text)
        first: list[str] = []
        at = 0
        for g in text.split("\n"):
            within = sorted({t for t, start, end, _ in inside if at <= start and end <= at + len(g)}, key=lambda t: (-len(t), t))
            first += [t for t in within if t not in first][:1]
            at += len(g) + 1
        return list(dict.fromkeys([*first, *(m[0] for m in matcher(places, pack, numeric=False)(q))]))

    # One UDF, so one Python process a task and one copy of the terms in it; more terms than can be sent are joined to the questions that hold them.
    vocabulary = entities.select(F.col("entity").alias("term"))
    terms = shared_terms(questions.sparkSession, vocabulary)
    if terms is None:

        @F.arrow_udf("array<string>")
        def own(qs: pa.Array, held: pa.Array) -> pa.Array:
            return pa.array([entities_of(q, _occurrences(h or ())) for q, h in zip(qs.to_pylist(), held.to_pylist())], pa.list_(pa.string()))

        held = held_terms(told.select(F.col("q").alias("key"), F.col("q").alias("text")).distinct(), vocabulary).select(F.col("key").alias("q"), F.col("held").alias("held_"))
        return told.join(held, "q", "left").withColumn("entities", own("q", "held_")).select(*told.columns, "entities")

    @F.arrow_udf("array<string>")
    def shared(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _occurrences(terms.value)
        for qs in batches:
            yield pa.array([entities_of(q, places) for q in qs.to_pylist()], pa.list_(pa.string()))

    return told.withColumn("entities", shared("q"))


# What each intent looks up, as (intent, side of the entity, relations, priority); lower priorities are fallbacks.
LOOKUPS = (
    ("DEFINITION", "out", ("instance_of", "is_a"), 0),
    *(("DEFINITION", "out", (r,), k) for k, r in enumerate(FALLBACKS, 1)),
    ("LIST_INSTANCE", "in", ("instance_of",), 0),
    ("VALUE", "out", VALUES, 0),
    ("CAUSE", "in", CAUSES, 0),
    ("EFFECT", "out", CAUSES, 0),
    ("LOCATION", "out", ("located_at",), 0),
    ("CHAPTER", "out", ("discussed_in",), 0),
    ("PROPERTY", "out", PROPERTIES, 1),
)
ALL_EDGES = ("SUMMARY", "NEIGHBOR", "UNKNOWN")
#: Intents that look for the relation of the question's pattern where it has one: side, and whether the list above is for others only.
HINTED = {"CAUSE": "in", "EFFECT": "out", "PROPERTY": "out"}


def _priority() -> Column:
    """Of (kind, side, rel, relation): one look-up in a literal map, so the expression stays small."""
    table = {f"{k}|{side}|{r}": n for k, side, rels, n in LOOKUPS for r in rels}
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.concat_ws("|", "kind", "side", "rel")]
    kind, hint = F.col("kind"), F.col("relation")
    asked = reduce(lambda a, kv: a | ((kind == kv[0]) & (F.col("side") == kv[1])), HINTED.items(), F.lit(False)) & (F.col("rel") == hint)
    only = kind.isin("CAUSE", "EFFECT") & hint.isNotNull()
    return F.when(kind.isin(*ALL_EDGES) | asked, 0).when(~only, known)


def retrieve(parsed: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """Answer rows of all questions: qid, intent, rank, head, relation, tail, score.

    Every intent is a look-up by (entity, direction, relations) with a priority for fallbacks: one join from questions
    to edge ends, the lowest priority that has rows, distinct keys, the best by score. RELATION takes edges between
    its two entities or else paths, in order of priority and not score.
    """
    q = parsed.select("qid", "intent", "relation", F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b")).where("a is not null")
    q = q.withColumn("kind", F.when((F.col("intent") == "RELATION") & F.col("b").isNull(), "NEIGHBOR").otherwise(F.col("intent")))
    # Both sides are read by several branches: as tables they are computed once.
    q = written(q, "asked")
    e = written(edges.groupBy("head", F.col("relation").alias("rel"), "tail").agg(F.max("score").alias("score")), "edges")
    end = F.explode(F.array(F.struct(F.col("head").alias("at"), F.lit("out").alias("side")), F.struct(F.col("tail").alias("at"), F.lit("in").alias("side"))))
    ends = e.select("*", end.alias("end")).select("*", "end.*").drop("end")
    cols = ["qid", "intent", "kind", "priority", "head", "rel", "tail", "score"]
    hit = q.where("kind <> 'RELATION'").join(ends, F.col("a") == F.col("at"))
    looked = hit.withColumn("priority", _priority()).where("priority is not null").select(*cols)
    # LIST_INSTANCE falls back to tails that hold the entity, for questions without an exact row: their substrings of asked lengths, by equality.
    bare = q.where("kind = 'LIST_INSTANCE'").join(looked.select("qid").distinct(), "qid", "left_anti")
    sizes = [r["n"] for r in q.where("kind = 'LIST_INSTANCE'").select(F.length("a").alias("n")).distinct().collect()]  # as many as names have lengths
    tails = e.where("rel = 'instance_of'").select("tail").distinct().select("tail", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).where(F.col("n") < F.length("tail"))
    held = tails.select("tail", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail") - F.col("n") + 1), lambda i: F.substring(F.col("tail"), i, F.col("n")))).alias("a")).distinct()
    part = bare.join(held, "a").join(e.where("rel = 'instance_of'"), "tail").withColumn("priority", F.lit(1)).select(*cols)
    # An entity has any number of edges, an answer few: those of lowest priority come first, and no more distinct ones than an answer holds go on.
    place = F.dense_rank().over(W.partitionBy("qid").orderBy("priority", -F.col("score"), "rel", "head", "tail"))
    rows = looked.unionByName(part).withColumn("place", place).where(F.col("place") <= max(LIMITS.values())).drop("place")
    two = q.where("kind = 'RELATION'")
    if two.isEmpty():  # paths are steps over all edges, whatever is asked
        return _ranked(rows)
    ahead = two.join(e, (F.col("a") == F.col("head")) & (F.col("b") == F.col("tail")))
    back = two.where("a <> b").join(e, (F.col("b") == F.col("head")) & (F.col("a") == F.col("tail")))
    straight = ahead.withColumn("priority", F.lit(0)).select(*cols).unionByName(back.withColumn("priority", F.lit(1)).select(*cols))
    far = two.join(straight.select("qid").distinct(), "qid", "left_anti")
    found = graph.paths(e.withColumnRenamed("rel", "relation"), far.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct(), max_hops, 4)
    found = found.withColumn("path", F.row_number().over(W.partitionBy("source", "target").orderBy("hops", "nodes"))).select("source", "target", "path", F.posexplode("steps").alias("k", "s"))
    walked = far.join(found, (F.col("a") == F.col("source")) & (F.col("b") == F.col("target"))).select("qid", "intent", "kind", (F.col("path") * 100 + F.col("k")).alias("priority"), F.col("s.head").alias("head"), F.col("s.relation").alias("rel"), F.col("s.tail").alias("tail"), F.col("s.score").alias("score"))
    return _ranked(rows.unionByName(straight).unionByName(walked))


def _ranked(rows: DataFrame) -> DataFrame:
    """Of each question's rows (with kind and priority) those of the lowest priority, distinct, the best by score; of a RELATION all, in order of priority."""
    per = W.partitionBy("qid")
    is_path = F.col("kind") == "RELATION"
    rows = rows.withColumn("low", F.min("priority").over(per)).where(is_path | (F.col("priority") == F.col("low")))
    rows = rows.groupBy("qid", "intent", "kind", "head", "rel", "tail").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    order = [F.when(F.col("kind") == "RELATION", F.col("priority")).otherwise(F.lit(0)), F.when(F.col("kind") == "RELATION", F.lit(0.0)).otherwise(-F.col("score")), F.col("rel"), F.col("head"), F.col("tail")]
    most = F.create_map(*(F.lit(x) for kv in LIMITS.items() for x in kv))
    ranked = rows.withColumn("rank", F.row_number().over(per.orderBy(*order)))
    return ranked.where(F.col("rank") <= most[F.col("kind")]).select("qid", "intent", "rank", "head", F.col("rel").alias("relation"), "tail", "score")


def related_triples(parsed: DataFrame, edges: DataFrame, answers: DataFrame, limit: int = 10) -> DataFrame:
    """Other edges of each question's first entity: qid, rank, head, relation, tail, score.

    Of an entity's edges only as many can be shown as the limit and the most answers of a question, so those are ranked
    once for all its questions; not every question meets every edge.
    """
    q = parsed.select("qid", F.get("entities", F.lit(0)).alias("a")).where("a is not null")
    most = answers.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    e = edges.groupBy("head", "relation", "tail").agg(F.max("score").alias("score"))
    mine = e.select("*", F.explode(F.array_distinct(F.array("head", "tail"))).alias("a")).withColumn("side", (F.col("head") != F.col("a")).cast("int"))
    mine = mine.join(q.select("a").distinct(), "a", "left_semi")
    order = ["side", F.desc("score"), "relation", "head", "tail"]
    best = mine.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(*order))).where(F.col("k") <= limit + most).drop("k")
    rest = q.join(best, "a").join(answers.select("qid", "head", "relation", "tail"), ["qid", "head", "relation", "tail"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit).select("qid", "rank", "head", "relation", "tail", "score")


def evidence(parsed: DataFrame, sentences: DataFrame, limit: int = 6) -> DataFrame:
    """Sentences (sid, text) of each question: with both entities, shortest of the first 12 by sid, for RELATION (or half for each); else with the first one, by sid."""
    from graphloom.operators.search import term_places

    q = parsed.select("qid", "intent", F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b")).where("a is not null")
    terms = q.select(F.explode(F.array_compact(F.array("a", "b"))).alias("term")).distinct()
    two = (F.col("intent") == "RELATION") & F.col("b").isNotNull()
    # Pairs: places alone (no texts) of the terms of such questions; texts join what is chosen.
    paired = q.where(two).select(F.explode(F.array("a", "b")).alias("term")).distinct()
    places = term_places(sentences, paired).select("term", "sid", "n")
    both = q.where(two).join(places.select(F.col("term").alias("a"), "sid", "n"), "a").join(places.select(F.col("term").alias("b"), "sid"), ["b", "sid"])
    both = both.withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy("sid"))).where(F.col("k") <= 2 * limit)
    both = both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("n", "sid"))).where(F.col("rank") <= limit).select("qid", "rank", "sid")
    rest = q.join(both.select("qid").distinct(), "qid", "left_anti").withColumn("each", F.when(two, F.array("a", "b")).otherwise(F.array("a")))
    few = term_places(sentences, terms, limit).select("term", "sid")
    single = rest.select("qid", F.posexplode("each").alias("k", "term"), F.size("each").alias("n")).join(few, "term")
    per = W.partitionBy("qid", "k").orderBy("sid")
    single = single.withColumn("r", F.row_number().over(per)).where(F.col("r") <= F.floor(F.lit(limit) / F.col("n")))
    single = single.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("k", "sid"))).select("qid", "rank", "sid")
    kept = [c for c in ("text", "section", "chapter") if c in sentences.columns]
    chosen = written(both.unionByName(single), "evidence")  # its size is known then, and texts needn't be shuffled to meet a few places
    return chosen.join(sentences.select("sid", *kept), "sid").select("qid", "rank", "sid", *kept)


def answers_text(parsed: DataFrame, rows: DataFrame, evidence_rows: DataFrame | None = None, rewrite: Callable[[str], str] | None = None, pack: Pack = ZH, related: DataFrame | None = None) -> DataFrame:
    """qid, answer, note, related: the intent's lead, at most 12 triples and 3 sentences with their section or chapter; what to do without an entity; other edges of the first entity. `rewrite` is an optional function of the text (an Arrow UDF calls it)."""
    line = F.format_string("(%s —%s→ %s)", "head", "relation", "tail")
    items = F.sort_array(F.collect_list(F.when(F.col("rank") <= 12, F.struct("rank", line.alias("line")))))
    listed = lambda df, name: df.groupBy("qid").agg(F.transform(items, lambda x: x["line"]).alias(name))
    out = parsed.select("qid", "intent", "q", "question", F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b")).join(listed(rows, "bullets"), "qid", "left")
    if evidence_rows is not None:
        has = evidence_rows.columns
        place = F.coalesce(*(F.nullif(strip(F.col(c)), F.lit("")) for c in ("section", "chapter") if c in has), F.lit(pack.body_label))
        quotes = F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.concat(F.lit("["), place, F.lit("] "), "text").alias("line")))))
        out = out.join(evidence_rows.groupBy("qid").agg(F.transform(quotes, lambda x: x["line"]).alias("quotes")), "qid", "left")
    else:
        out = out.withColumn("quotes", F.lit(None).cast("array<string>"))
    out = out.join(listed(related, "related"), "qid", "left") if related is not None else out.withColumn("related", F.lit(None).cast("array<string>"))
    filled = lambda lead: F.replace(F.replace(F.lit(lead), F.lit("{a}"), F.coalesce("a", F.lit(""))), F.lit("{b}"), F.coalesce("b", F.lit("")))
    leads = pack.leads or ZH.leads
    lead = reduce(lambda o, kv: F.when(F.col("intent") == kv[0], filled(kv[1])).otherwise(o), [x for x in leads.items() if x[0] != "UNKNOWN"], filled(leads["UNKNOWN"]))
    lines = lambda c, mark: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    bullets = F.when(F.col("bullets").isNull(), F.array(F.lit(f"  • {NO_TRIPLE}"))).otherwise(lines("bullets", "  • "))
    proofs = F.when(F.col("quotes").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(""), F.lit(EVIDENCE)), lines("quotes", "  · ")))
    nothing = F.concat(F.lit(NOTHING[0]), F.coalesce("a", "question"), F.lit(NOTHING[1]))
    answer = F.when(F.col("bullets").isNull() & F.col("quotes").isNull(), nothing).otherwise(F.array_join(F.concat(F.array(lead), bullets, proofs), "\n"))
    out = out.select("qid", answer.alias("answer"), F.when(F.col("a").isNull(), F.lit(NO_ENTITY)).alias("note"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))
    if rewrite is None:
        return out

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return rewrite(t) or t
            except Exception:  # the plain answer stands when the service fails
                return t

        return texts.map(one)

    return out.withColumn("answer", run("answer"))
