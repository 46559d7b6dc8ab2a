"""Queries over hand-made rows whose results follow from the definitions, each with SQL of the expected rows, and round trips through files. They show operators that the test tables can't (Chinese text, parses, rare cases)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH
from graphloom.functions.text import clean_text
from graphloom.operators import curate, dependency, evaluate, graph, mentions, merge, preprocess, questions, relations, search
from graphloom.plans.commerce import EDGES_SQL, commerce_edges, load
from graphloom.sources import files
from graphloom.sources.shared import fresh_path

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TYPES = {"s": "VARCHAR", "i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"


def expect(columns: str, *rows: tuple):
    """Registers a query with its expected rows; columns: name:type, with types s, i, l, d, b."""
    names = [c.split(":") for c in columns.split()]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = "SELECT " + ", ".join(f'c{k}::{TYPES[t]} AS "{n}"' for k, (n, t) in enumerate(names)) + f" FROM (VALUES {body}) AS v({', '.join(f'c{k}' for k in range(len(names)))})"
        return f

    return add


def equals(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


TERMS = ("折叠翼", "升阻比", "机翼", "副翼", "翼展", "活动机翼", "作动器")


def _vocab(spark):
    return spark.createDataFrame([(t, "STRUCTURAL_COMPONENT" if "翼" in t else "PARAMETER", 0, i) for i, t in enumerate(TERMS)], "term string, etype string, etype_ord int, term_ord int")


def _sentences(spark, *texts, chapter=""):
    return spark.createDataFrame([(1, 0, chapter, "", i, t) for i, t in enumerate(texts)], "doc_id long, paragraph_id int, chapter string, section string, sentence_id int, text string")


def _triples(spark, *rows):
    return spark.createDataFrame(list(rows), "head string, relation string, tail string")


SHOWN = ["sentence_id", "head", "relation", "tail", "score"]


@expect("doc_id:l paragraph_id:i chapter:s section:s text:s", (1, 0, "第4章气动", "", "1.1研究背景与意义内容"), (1, 1, "第4章气动", "", "甲甲甲甲甲甲甲。乙；丙丙丙丙丙丙丙！"), (2, 0, "", "", "没有章节的一段文字"))
def p2_p4_chapters_zh(spark, d):
    docs = spark.createDataFrame([(1, "第4章 气动\n短\n1.1 研究背景与意义内容\n甲甲甲甲甲甲甲。乙；丙丙丙丙丙丙丙！"), (2, "没有章节的一段文字 [1,2]"), (3, None)], "doc_id long, text string")
    return preprocess.paragraphs(docs)


@expect("doc_id:l paragraph_id:i chapter:s section:s text:s", (1, 0, "第4章气动", "1.1研究背景", "甲甲甲甲甲甲甲甲甲"), (1, 1, "第5章结构", "", "乙乙乙乙乙乙乙乙乙"))
def p3_fixed_sections_zh(spark, d):
    docs = spark.createDataFrame([(1, "第4章 气动\n1.1 研究背景\n甲甲甲甲甲甲甲甲甲\n第5章 结构\n乙乙乙乙乙乙乙乙乙")], "doc_id long, text string")
    return preprocess.paragraphs(docs, fix_sections=True)


@expect("chunk_id:i label:s text:s", (0, "导言", "前言"), (1, "第 1 章 绪论 #1", "1234\n56789"), (2, "第 1 章 绪论 #2", "0"), (3, "2.1 方法", "  ab"), (4, "第 1 章 绪论", "z"))
def p6_chunks_zh(spark, d):
    docs = spark.createDataFrame([(1, "前言\n\n第 1 章 绪论\n1234\n56789\n0\n2.1 方法\n  ab\n第 1 章 绪论\nz")], "doc_id long, text string")
    return preprocess.chunks(docs, target=9).drop("doc_id")


@expect("sentence_id:i mention:s start:i end:i etype:s", (1, "F-111", 1, 6, "aircraft_code"), (2, "5m", 1, 3, "numeric"), (3, "5-10m", 1, 6, "numeric"), (4, "折叠翼", 0, 3, "vocab"), (4, "升阻比", 5, 8, "vocab"), (5, "活动机翼", 0, 4, "vocab"), (5, "作动器", 5, 8, "vocab"), (5, "副翼", 10, 12, "vocab"))
def n2_n5_mentions_zh(spark, d):
    found = mentions.with_mentions(_sentences(spark, "的F-111飞机", "（F-111）", "长5mm", "约5-10m", "折叠翼改善升阻比", "活动机翼由作动器驱动副翼"), _vocab(spark))
    return mentions.exploded(found).select("sentence_id", "mention", "start", "end", "etype")


@expect("sentence_id:i mention:s start:i end:i", (0, "活动机翼", 0, 4), (0, "机翼", 2, 4), (0, "副翼", 5, 7))
def n1_joined_vocabulary(spark, d):
    """Any number of terms: the join that stands in for the broadcast."""
    found = mentions._by_join(_sentences(spark, "活动机翼和副翼"), _vocab(spark), ZH, False, False, False)
    return mentions.exploded(found).select("sentence_id", "mention", "start", "end")


@expect("term:s", ("机翼",), ("翼梁",))
def n6_add_terms(spark, d):
    t = lambda *x: spark.createDataFrame([(y,) for y in x], "term string")
    return mentions.add_terms(t("机翼"), t("翼梁", "机翼"))


@expect("term:s n:l", ("自适应机翼", 2), ("机翼", 3))
def n7_mined_terms(spark, d):
    spans = spark.createDataFrame([(["机翼", "机翼", "自适应机翼", "x"],), (["机翼", "自适应机翼", "本文"],), (["机翼", "一次"],), (["本文"],)], "spans array<string>")
    return mentions.mined_terms(spans, ("本文",))


@expect("sentence_id:i head:s relation:s tail:s score:d", (0, "折叠翼", "improves", "升阻比", 0.86), (1, "折叠翼", "improves", "升阻比", 0.45), (2, "机翼", "has_part", "副翼", 0.71), (3, "翼展", "less_than", "20m", 0.59), (4, "机翼", "manufactures", "折叠翼", 0.7))
def x1_x7_triggers_zh(spark, d):
    found = mentions.with_mentions(_sentences(spark, "折叠翼改善升阻比", "折叠翼不改善升阻比", "机翼包括副翼", "翼展不超过20m", "折叠翼由研制机翼", "机翼包括20m"), _vocab(spark))
    return relations.trigger_triples(found).select(*SHOWN)


@expect("sentence_id:i head:s relation:s tail:s score:d", (0, "活动机翼", "driven_by", "副翼", 0.82), (1, "机翼", "connected_to", "副翼", 0.85), (2, "机翼", "has_part", "副翼", 0.82), (2, "机翼", "has_part", "折叠翼", 0.82), (2, "机翼", "has_part", "作动器", 0.82))
def x8_x10_patterns_zh(spark, d):
    texts = _sentences(spark, "活动机翼由作动器驱动副翼", "机翼与副翼连接", "机翼包括副翼、折叠翼，作动器")
    return relations.pattern_triples(texts, TERMS).select(*SHOWN)


@expect("sentence_id:i head:s relation:s tail:s score:d", (0, "翼展", "has_value", "20m", 0.78), (0, "翼展", "less_than_value", "20m", 0.78), (1, "活动机翼", "greater_than_value", "3kg", 0.78))
def x11_x12_quantities_zh(spark, d):
    return relations.numeric_triples(_sentences(spark, "翼展不超过20m", "这活动机翼大于3kg"), TERMS).select(*SHOWN)


def _parsed(spark):
    """Parses: plain, negated through a left dependent, passive, inherited subject, pronoun, vague head, copulas with and without a digit (their subtree holds the subject, so the name must be half of it), numeric tail that the relation forbids."""
    parses = [
        [(0, "新型", "ADJ", "amod", 1), (1, "机翼", "NOUN", "nsubj", 2), (2, "采用", "VERB", "ROOT", 2), (3, "副翼", "NOUN", "dobj", 2)],
        [(0, "机翼", "NOUN", "nsubj", 3), (1, "并", "ADV", "advmod", 2), (2, "不", "ADV", "neg", 3), (3, "采用", "VERB", "ROOT", 3), (4, "副翼", "NOUN", "dobj", 3)],
        [(0, "折叠翼", "NOUN", "nsubjpass", 2), (1, "被", "ADP", "case", 2), (2, "研制", "VERB", "ROOT", 2), (3, "作动器", "NOUN", "dobj", 2)],
        [(0, "机翼", "NOUN", "nsubj", 1), (1, "想", "VERB", "ROOT", 1), (2, "改善", "VERB", "xcomp", 1), (3, "升阻比", "NOUN", "dobj", 2)],
        [(0, "它们", "PRON", "nsubj", 1), (1, "采用", "VERB", "ROOT", 1), (2, "副翼", "NOUN", "dobj", 1)],
        [(0, "机翼", "NOUN", "compound", 1), (1, "变体过程中", "NOUN", "nsubj", 2), (2, "采用", "VERB", "ROOT", 2), (3, "副翼", "NOUN", "dobj", 2)],
        [(0, "翼展", "NOUN", "nsubj", 2), (1, "是", "AUX", "cop", 2), (2, "活动机翼3", "NOUN", "ROOT", 2)],
        [(0, "翼展", "NOUN", "nsubj", 2), (1, "是", "AUX", "cop", 2), (2, "活动机翼", "NOUN", "ROOT", 2)],
        [(0, "机翼", "NOUN", "nsubj", 1), (1, "采用", "VERB", "ROOT", 1), (2, "20m", "NUM", "dobj", 1)],
    ]
    rows = [(1, "第1章", k, "".join(t[1] for t in p), p) for k, p in enumerate(parses)] + [(1, "", 99, "无", None)]
    return spark.createDataFrame(rows, "doc_id long, chapter string, sentence_id int, text string, tokens array<struct<i:int,text:string,pos:string,dep:string,head:int>>")


@expect("sentence_id:i head:s relation:s tail:s score:d", (0, "机翼", "uses_method", "副翼", 0.83), (1, "机翼", "uses_method", "副翼", 0.63), (2, "作动器", "manufactures", "折叠翼", 0.85), (3, "机翼", "improves", "升阻比", 0.83), (6, "翼展", "has_value", "活动机翼", 0.72), (7, "翼展", "is_a", "活动机翼", 0.66))
def x14_x16_dependencies_zh(spark, d):
    return dependency.dependency_triples(_parsed(spark), TERMS, rule="dep").select(*SHOWN)


@expect("sentence_id:i head:s relation:s tail:s score:d", (0, "机翼", "uses_method", "副翼", 0.62), (1, "机翼", "uses_method", "副翼", 0.62), (2, "折叠翼", "manufactures", "作动器", 0.62), (5, "机翼", "uses_method", "副翼", 0.62))
def x13_svo_zh(spark, d):
    return dependency.dependency_triples(_parsed(spark), TERMS, rule="svo").select(*SHOWN)


@expect("predicate:s relation:s", ("研制", "manufactures"), ("被研制出", "manufactures"), ("显著提升了", "improves"), ("跑", "related_to"))
def x20_predicates_zh(spark, d):
    words = spark.createDataFrame([(w,) for w in ("研制", "被研制出", "显著提升了", "跑")], "predicate string")
    return words.select("predicate", relations.normalize_predicate(F.col("predicate")).alias("relation"))


@expect("head:s tail:s score:d sentence:s chapter:s", ("折叠翼", "第1章", 0.8, "折叠翼的升阻比很高", "第1章"), ("升阻比", "第1章", 0.8, "折叠翼的升阻比很高", "第1章"), ("机翼", "第1章", 0.59, "机翼机翼", "第1章"))
def x19_chapter_mentions_zh(spark, d):
    flat = mentions.exploded(mentions.with_mentions(_sentences(spark, *["折叠翼的升阻比很高"] * 13, "机翼机翼", "副翼", chapter="第1章"), _vocab(spark)))
    return relations.chapter_triples(flat, _vocab(spark)).select("head", "tail", F.round("score", 6).alias("score"), "sentence", "chapter")


def _candidates(spark, *rows):
    return spark.createDataFrame([(h, r, t, trig, src, s, ch, se, 0, 0, i) for i, (h, r, t, trig, src, s, ch, se) in enumerate(rows)], "head string, relation string, tail string, trigger string, source string, score double, chapter string, sentence string, stage int, sentence_id int, ord long")


@expect("head:s relation:s tail:s trigger:s source:s score:d chapter:s sentence:s", ("a1", "r", "b1", "p", "trigger+pattern+pattern", 0.7, "c", "s"), ("a2", "r", "b2", "p", "pattern+trigger", 0.82, "k", "u"), ("157度", "r", "x", "", "s", 1.0, "", ""), ("w", "has_value", "5", "", "s", 1.0, "", ""))
def m1_m2_merge_fold(spark, d):
    one, two = ("a1", "r", "b1"), ("a2", "r", "b2")
    rows = [(*one, "", "trigger", 0.7, "", "s"), (*one, "p", "pattern", 0.7, "c", "t"), (*one, "q", "pattern", 0.6, "", ""), ("10%", "r", "x", "", "s", 1.0, "", ""), ("157度", "r", "x", "", "s", 1.0, "", ""), ("w", "has_part", "5", "", "s", 1.0, "", ""), ("w", "has_value", "5", "", "s", 1.0, "", ""), ("w", "r", "w", "", "s", 1.0, "", "")]
    return merge.merge_triples(_candidates(spark, *rows, (*two, "t", "trigger", 0.71, "c", "s"), (*two, "p", "pattern", 0.82, "", "u"), (*two, "x", "trigger", 0.5, "k", "")))


@expect("head:s relation:s tail:s source:s score:d", ("机翼", "has_part", "副翼", "pattern", 0.82), ("折叠翼", "improves", "升阻比", "trigger", 0.86), ("翼展", "has_value", "20m", "numeric", 0.78), ("翼展", "less_than_value", "20m", "numeric", 0.78), ("翼展", "less_than", "20m", "trigger", 0.59), ("折叠翼", "instance_of", "结构部件", "type", 0.92), ("机翼", "instance_of", "结构部件", "type", 0.92), ("副翼", "instance_of", "结构部件", "type", 0.92), ("翼展", "instance_of", "结构部件", "type", 0.92), ("升阻比", "instance_of", "设计参数", "type", 0.92), ("副翼", "discussed_in", "第1章机翼", "chapter", 0.59), ("翼展", "discussed_in", "第1章机翼", "chapter", 0.59))
def m3_m7_extraction_zh(spark, d):
    """Whole extraction: rules, gate, merge, observed types, filter, polish."""
    from graphloom.plans.extraction import extract

    docs = spark.createDataFrame([(1, "第1章 机翼\n机翼包括副翼。折叠翼改善升阻比。翼展不超过20m。副翼不改善翼展。"), (2, None)], "doc_id long, text string")
    return extract(docs, _vocab(spark)).edges.select("head", "relation", "tail", "source", "score")


@expect("head:s relation:s tail:s score:d", ("a", "r", "b", 0.9), ("c", "r", "d", 0.5))
def m4_polished(spark, d):
    e = spark.createDataFrame([(" a", "r", "b ", 0.9, "x"), ("a", "r", "b", 0.8, "y"), ("c", " r", "d", 0.5, "x"), ("", "r", "d", 1.0, "x"), ("e", "r", "e ", 1.0, "x")], "head string, relation string, tail string, score double, source string")
    return merge.polished(e).drop("source")


@expect("head:s relation:s tail:s", ("X", "has_part", "y"), ("X", "instance_of", "z"), ("n", "is_a", "X"))
def e1_e4_keys(spark, d):
    """Chapter, global relations, relation names, aliases (first registration wins), exclusion."""
    raw = spark.createDataFrame([("x", "组成", "y", "第4章"), ("x", "instance_of", "z", ""), ("x", "causes", "z", ""), ("q", "r", "q", "第4章"), ("n", "属于", "x1", "第4章 气动"), ("x", "discussed_in", "第4章", "第4章"), ("o", "r", "p", "第5章")], "head string, relation string, tail string, chapter string")
    names = spark.createDataFrame([("X", "x", 0), ("X", "x1", 1), ("Y", "x1", 2), ("_note", "y", 3)], "canonical string, alias string, ord int")
    return evaluate.keys(raw, aliases=evaluate.first_aliases(names), chapter="第4章", exclude=("discussed_in",))


@expect("p_head:s p_tail:s g_head:s g_tail:s", ("ab", "xx", "ab", "xx"), ("abc", "xx", "abcd", "xx"), ("连杆", "机翼", "连杆最大扭矩", "机翼"))
def e8_partial_pairs(spark, d):
    pred = _triples(spark, ("ab", "r", "xx"), ("abc", "r", "xx"), ("连杆", "r", "机翼"), ("A", "r", "机翼"), ("连杆", "s", "机翼"))
    gold = _triples(spark, ("ab", "r", "xx"), ("abcd", "r", "xx"), ("连杆最大扭矩", "r", "机翼"), ("AB", "r", "机翼"))
    return evaluate.partial_matches(pred, gold).drop("relation")


@expect("kind:s tp:l n_pred:l n_gold:l precision:d recall:d f1:d", ("some", 1, 2, 3, 0.5, 0.333333, 0.4), ("empty", 0, 0, 0, 1.0, 1.0, 1.0))
def e5_ratios(spark, d):
    pred, gold = _triples(spark, ("a", "r", "b"), ("a", "r", "c")), _triples(spark, ("a", "r", "b"), ("d", "r", "e"), ("f", "r", "g"))
    some, none = evaluate.prf(pred, gold, evaluate.KEY), evaluate.prf(pred.limit(0), pred.limit(0), evaluate.KEY)
    return some.withColumn("kind", F.lit("some")).unionByName(none.withColumn("kind", F.lit("empty"))).withColumn("recall", F.round("recall", 6)).withColumn("f1", F.round("f1", 6))


@expect("line:s", ("strict     P 0.5000 R 0.3333 F1 0.4000 TP 1 of 2 / 3",), ("pair       P 0.5000 R 0.3333 F1 0.4000 TP 1 of 2 / 3",), ("entity     P 0.6667 R 0.3333 F1 0.4444 TP 2 of 3 / 6",), ("partial    P 0.5000 R 0.3333 F1 0.4000 TP 1 of 2 / 3",), ("r          P 0.5000 R 0.3333 F1 0.4000 TP 1 of 2 / 3",), ("macro F1 0.4000",))
def e14_report(spark, d):
    pred, gold = _triples(spark, ("a", "r", "b"), ("a", "r", "c")), _triples(spark, ("a", "r", "b"), ("d", "r", "e"), ("f", "r", "g"))
    return spark.createDataFrame([(x,) for x in evaluate.report(pred, gold).split("\n")], "line string")


def _graph(spark):
    return spark.createDataFrame([("a", "r", "b", 0.9), ("b", "s", "c", 0.5), ("b", "r", "c", 0.8), ("c", "r", "d", 0.7), ("d", "r", "a", 0.6), ("d", "r", "g", 0.4), ("e", "r", "f", 1.0)], "head string, relation string, tail string, score double")


@expect("source:s target:s hops:i nodes:s steps:s", ("a", "c", 2, "a|b|c", "a-r-b b-r-c"), ("a", "c", 2, "a|d|c", "d-r-a c-r-d"), ("b", "g", 3, "b|a|d|g", "a-r-b d-r-a d-r-g"), ("b", "g", 3, "b|c|d|g", "b-r-c c-r-d d-r-g"))
def g7_paths_with_steps(spark, d):
    ends = spark.createDataFrame([("a", "c"), ("a", "f"), ("a", "a"), ("b", "g")], "source string, target string")
    steps = F.array_join(F.transform("steps", lambda x: F.concat_ws("-", x["head"], x["relation"], x["tail"])), " ")
    return graph.paths(_graph(spark), ends).select("source", "target", "hops", F.array_join("nodes", "|").alias("nodes"), steps.alias("steps"))


@expect("head:s tail:s side:i", ("a", "b", 0), ("d", "a", 1))
def g3_sides(spark, d):
    return graph.triples_of(_graph(spark), "a").select("head", "tail", "side")


@expect("head:s tail:s", ("a", "b"), ("d", "a"))
def g8_capped_neighbourhood(spark, d):
    """Two hops from a, the three nearest entities (a, b, d), the edges between them."""
    return graph.neighbourhood(_graph(spark), "a", 2, max_nodes=3).select("head", "tail")


@expect("entity:s degree:l", ("d", 3))
def g10_centre(spark, d):
    edges = _graph(spark).where("relation = 'r'")
    return graph.centre(edges)


@expect("kind:s name:s", ("type", "PLACE"), ("type", "_UNKNOWN_"), ("relation", "place"), ("relation", "made_of"))
def v3_legend(spark, d):
    edges = _triples(spark, ("x", "located_at", "y"), ("x", "made_of", "z"))
    types = spark.createDataFrame([("y", "PLACE")], "term string, etype string")
    return graph.legend(edges, types, {"place": ("located_at", "part_of")})


@expect("entity:s ratio:d", ("apple", 0.8), ("ape", 0.75))
def c5_close_matches_small(spark, d):
    return search.close_matches(spark.createDataFrame([("apple",), ("ape",), ("xyz",)], "entity string"), "appel").withColumn("ratio", F.round("ratio", 6))


_KG = [("机翼", "instance_of", "部件", 0.9), ("机翼", "has_part", "副翼", 0.8), ("副翼", "located_at", "后缘", 0.7), ("机翼", "has_value", "20m", 0.6), ("载荷", "causes", "变形", 0.9), ("变形", "reduces", "升力", 0.8), ("机翼", "discussed_in", "第4章", 0.7), ("副翼", "used_for", "滚转", 0.75), ("后掠翼", "instance_of", "机翼构型", 0.9)]
_ASKED = [(1, "请问机翼是什么？"), (2, "副翼是什么"), (3, "机翼的值是多少"), (4, "什么导致变形"), (5, "变形会降低什么"), (6, "副翼在哪"), (7, "机翼由什么组成"), (8, "后缘和机翼的联系"), (9, "机翼和副翼的关系"), (10, "升力相关的邻居"), (11, "载荷呢"), (12, "列举构型"), (13, "介绍变形"), (14, "你好吗")]


def _kg(spark):
    return spark.createDataFrame(_KG, "head string, relation string, tail string, score double")


def _parse(spark):
    names = merge.entities(_kg(spark)).union(spark.createDataFrame([("构型",)], "entity string"))
    return questions.parse_questions(spark.createDataFrame(_ASKED, "qid long, question string"), names)


@expect("qid:l intent:s entities:s", (1, "DEFINITION", "机翼"), (2, "DEFINITION", "副翼"), (3, "VALUE", "机翼"), (4, "CAUSE", "变形"), (5, "EFFECT", "变形"), (6, "LOCATION", "副翼"), (7, "PROPERTY", "机翼"), (8, "RELATION", "后缘|机翼"), (9, "RELATION", "机翼|副翼"), (10, "NEIGHBOR", "升力"), (11, "UNKNOWN", "载荷"), (12, "LIST_INSTANCE", "构型"), (13, "SUMMARY", "变形"), (14, "UNKNOWN", ""))
def q1_q3_parsed_zh(spark, d):
    return _parse(spark).select("qid", "intent", F.array_join("entities", "|").alias("entities"))


@expect("qid:l rank:i head:s relation:s tail:s", (1, 1, "机翼", "instance_of", "部件"), (2, 1, "副翼", "used_for", "滚转"), (3, 1, "机翼", "has_value", "20m"), (4, 1, "载荷", "causes", "变形"), (5, 1, "变形", "reduces", "升力"), (6, 1, "副翼", "located_at", "后缘"), (7, 1, "机翼", "has_part", "副翼"), (8, 1, "副翼", "located_at", "后缘"), (8, 2, "机翼", "has_part", "副翼"), (9, 1, "机翼", "has_part", "副翼"), (10, 1, "变形", "reduces", "升力"), (11, 1, "载荷", "causes", "变形"), (12, 1, "后掠翼", "instance_of", "机翼构型"), (13, 1, "载荷", "causes", "变形"), (13, 2, "变形", "reduces", "升力"))
def q4_q12_all_intents_zh(spark, d):
    return questions.retrieve(_parse(spark), _kg(spark)).select("qid", "rank", "head", "relation", "tail")


_LINES = [(1, "机翼很长", "", "第1章"), (2, "机翼后缘有副翼", "1.1 结构", "第1章"), (3, "后缘", "", ""), (4, "载荷大", "", "")]


def _proofs(spark):
    return spark.createDataFrame(_LINES, "sid long, text string, section string, chapter string")


@expect("qid:l rank:i sid:l", (1, 1, 1), (1, 2, 2), (8, 1, 2), (9, 1, 2), (11, 1, 4))
def q13_evidence_zh(spark, d):
    return questions.evidence(_parse(spark).where("qid in (1, 8, 9, 11, 14)"), _proofs(spark)).select("qid", "rank", "sid")


@expect("qid:l rank:i head:s tail:s", (1, 1, "机翼", "副翼"), (1, 2, "机翼", "第4章"), (1, 3, "机翼", "20m"))
def q14_related_zh(spark, d):
    parsed = _parse(spark).where("qid = 1")
    return questions.related_triples(parsed, _kg(spark), questions.retrieve(parsed, _kg(spark))).select("qid", "rank", "head", "tail")


@expect("qid:l answer:s note:s related:s", (1, "关于「机翼」是什么，知识图谱中给出的回答如下：\n  • (机翼 —instance_of→ 部件)\n\n原文佐证：\n  · [第1章] 机翼很长\n  · [1.1 结构] 机翼后缘有副翼", None, "(机翼 —has_part→ 副翼)|(机翼 —discussed_in→ 第4章)|(机翼 —has_value→ 20m)"), (9, "「机翼」与「副翼」之间的关系：\n  • (机翼 —has_part→ 副翼)\n\n原文佐证：\n  · [1.1 结构] 机翼后缘有副翼", None, "(机翼 —instance_of→ 部件)|(机翼 —discussed_in→ 第4章)|(机翼 —has_value→ 20m)"), (14, "未在知识图谱与论文中找到与「你好吗」直接相关的内容。请尝试更换关键词，或在左侧切换为「全局浏览」模式查看可用实体。", "没有从问题中识别到任何领域实体。建议把要查的实体写明确，例如：「全球鹰 是多少」", ""))
def q15_q16_answers_zh(spark, d):
    from graphloom.plans.extraction import answer

    asked = spark.createDataFrame(_ASKED, "qid long, question string").where("qid in (1, 9, 14)")
    return answer(asked, _kg(spark), _proofs(spark)).select("qid", "answer", "note", F.array_join("related", "|").alias("related"))


@expect("answer:s", ("重写：关于「机翼」",), ("未在知识图谱与论文中找到与「你好吗」直接相关的内容。请尝试更换关键词，或在左侧切换为「全局浏览」模式查看可用实体。",))
def q17_rewrite(spark, d):
    """A service that rewrites one answer and fails at another, which then stays."""
    from graphloom.plans.extraction import answer

    def rewrite(text: str) -> str:
        if text.startswith("未"):
            raise TimeoutError
        return "重写：" + text[:6]

    return answer(spark.createDataFrame(_ASKED, "qid long, question string").where("qid in (1, 14)"), _kg(spark), rewrite=rewrite).select("answer")


@expect("head:s relation:s tail:s", ("连杆", "r", "机翼"), ("x", "s", "y"), ("整流罩", "r", "机翼"))
def t1_align_gold(spark, d):
    pred = _triples(spark, ("连杆", "r", "机翼"), ("翼", "r", "机翼"), ("整流罩", "r", "机翼"), ("流罩", "r", "机翼"))
    return curate.align_gold(_triples(spark, ("大连杆", "r", "机翼"), ("x", "s", "y"), ("整流罩", "r", "机翼")), pred)


@expect("term:s etype:s examples:s", ("大副翼", "STRUCTURAL_COMPONENT", "大副翼 r 机翼"), ("NACA0012", "AIRCRAFT", "NACA0012 r 前进方法"), ("前进方法", "TECHNOLOGY", "NACA0012 r 前进方法"), ("Boeing", "PERSON", "Boeing r 东西"), ("东西", "GIVEN", "Boeing r 东西"), ("联翼布局", "WING_CONFIGURATION", "联翼布局 r 机翼"), ("机身前方", "CONCEPT", "机身前方 r 机翼"))
def t4_suggest_terms(spark, d):
    gold = _triples(spark, ("大副翼", "r", "机翼"), ("NACA0012", "r", "前进方法"), ("Boeing", "r", "东西"), ("20m", "r", "机翼"), ("约20m", "r", "机翼"), ("联翼布局", "r", "机翼"), ("机身前方", "r", "机翼"))
    types = spark.createDataFrame([("东西", "GIVEN")], "entity string, type string")
    return curate.suggest_terms(gold, _vocab(spark), types).select("term", "etype", F.array_join("examples", "|").alias("examples"))


@expect("term:s etype:s", ("机翼", "S"), ("翼梁", "A"), ("翼肋", "B"))
def t5_merge_terms(spark, d):
    t = lambda *rows: spark.createDataFrame(list(rows), "term string, etype string")
    return curate.merge_terms(t(("机翼", "S")), t(("翼梁", "A"), ("翼肋", "B"), ("机翼", "Z")))


@expect("term:s etype:s", ("机翼", "N"), ("翼肋", "B"))
def t7_audit_terms(spark, d):
    t = lambda names, *rows: spark.createDataFrame(list(rows), names)
    return curate.audit_terms(t("term string, etype string", ("机翼", "S"), ("翼梁", "A"), ("翼肋", "B")), t("term string", ("翼梁",)), t("term string, new_type string", ("机翼", "N")))


@expect("term:s etype:s", ("翼梁", "S"))
def t8_valid_new_terms(spark, d):
    new = spark.createDataFrame([("翼梁", "S", "有翼梁"), ("翼肋", "S", "没有"), ("机翼", "S", "机翼"), ("q", "S", "q"), ("翼尖", "?", "翼尖")], "term string, etype string, text string")
    return curate.valid_new_terms(new, _vocab(spark), ("S",))


@expect("head:s relation:s tail:s source:s score:d", ("a", "r", "b", "trigger+llm", 0.9), ("n", "r", "m", "llm", 0.7), ("e", "r", "f", "trigger", 0.4))
def l1_l2_l4_enhanced(spark, d):
    """A service that keeps and adds in one chapter (in a code fence, with an invalid triple) and fails in another."""

    def client(text: str, edges: list[dict]) -> str:
        if text != "甲\n乙":
            raise TimeoutError
        return '```json\n{"kept": [{"head": "a", "relation": "r", "tail": "b", "score": 0.9}, {"head": "a", "relation": "r", "tail": "a"}], "added": [{"head": " n", "relation": "r", "tail": "m"}]}\n```'

    edges = _candidates(spark, ("a", "r", "b", "t", "trigger", 0.8, "第1章", "s"), ("c", "r", "d", "t", "trigger", 0.6, "第1章", "s"), ("e", "r", "f", "t", "trigger", 0.4, "第2章", "s")).drop("stage", "sentence_id", "ord")
    texts = _sentences(spark, "甲", "乙", chapter="第1章")
    return curate.enhanced(edges, client, texts).select("head", "relation", "tail", "source", "score")


@expect("head:s relation:s tail:s", ("机翼", "is_a", "部件"))
def l3_l5_discover(spark, d):
    """Of five proposals one is new, allowed and in the text; a chapter under 40 characters isn't asked."""

    def client(text: str, chapter: str, known: list[dict]) -> list[dict]:
        rows = [("机翼", "is_a", "部件"), ("机翼", "zz", "部件"), ("机翼", "is_a", "没有"), ("机翼", "has_part", "副翼"), ("机翼", "is_a", "机翼")]
        return [dict(zip(("head", "relation", "tail"), r)) for r in rows]

    chapters = spark.createDataFrame([("第1章", "机翼是部件，含副翼。" * 8), ("第2章", "机翼是部件")], "chapter string, text string")
    edges = spark.createDataFrame([("第1章", "机翼", "has_part", "副翼")], "chapter string, head string, relation string, tail string")
    return curate.discover(chapters, edges, client, ("is_a", "has_part")).select("head", "relation", "tail")


# Round trips through files of the shared folder.


def _encoded(spark, df: DataFrame, encoding: str, path: str) -> None:
    """One file for each row of df(name, text)."""

    @F.pandas_udf("binary")
    def encode(texts):
        return texts.map(lambda t: t.encode(encoding))

    df.select("name", encode("text").cast("string").alias("value")).write.partitionBy("name").option("lineSep", "\n").text(path)


@equals("SELECT item_id, md5(text || chr(10)) AS text FROM benchmark")
def s1_texts_in_encodings(spark, d):
    """Each benchmark item as a file, in one of three encodings, read back."""
    path = fresh_path(spark, "texts")
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("name"), "text")
    for k, encoding in enumerate(("utf-8", "utf-8-sig", "gb18030")):
        _encoded(spark, items.where(F.col("name") % 3 == k), encoding, f"{path}/{k}")
    got = files.read_texts(spark, f"{path}/*/name=*/part-*")
    return got.select(F.regexp_extract("doc_id", r"name=(\d+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text"))


def _word_types(spark, d):
    words = load(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("term")).where("length(term) >= 1")
    typed = words.withColumn("etype", F.when(F.length("term") < 6, "A_SHORT").otherwise("B_LONG")).union(words.where("length(term) = 7").withColumn("etype", F.lit("C_SEVEN")))
    return typed.groupBy("etype").agg(F.sort_array(F.collect_set("term")).alias("terms")).groupBy().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("etype", "terms"))))).alias("value"))


_WORDS_SQL = "w AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS term FROM benchmark) WHERE length(term) >= 2), v AS (SELECT term, CASE WHEN length(term) < 6 THEN 'A_SHORT' ELSE 'B_LONG' END AS etype FROM w UNION ALL SELECT term, 'C_SEVEN' FROM w WHERE length(term) = 7)"


def _dictionary(spark, d):
    path = fresh_path(spark, "dictionary")
    _word_types(spark, d).coalesce(1).write.text(path)
    return files.read_vocabulary(spark, f"{path}/part-*")


@equals(f"WITH {_WORDS_SQL} SELECT term, etype FROM v")
def s2_dictionary_file(spark, d):
    """All words of the benchmark as a JSON dictionary, read back: terms of two characters or more."""
    return _dictionary(spark, d).select("term", "etype")


@equals(f"WITH {_WORDS_SQL} SELECT term, min(etype) AS etype FROM v GROUP BY term")
def s6_first_types(spark, d):
    return files.first_types(_dictionary(spark, d))


@equals(f"WITH {_WORDS_SQL} SELECT term, etype FROM v")
def s10_export_dictionary(spark, d):
    path = fresh_path(spark, "exported")
    files.export_vocabulary(_dictionary(spark, d), path)
    return files.read_vocabulary(spark, f"{path}/part-*").select("term", "etype")


@expect("term:s etype:s", ("机翼", "A"), ("副翼", "B"), ("机翼", "B"))
def s2_s3_usable_terms(spark, d):
    types = {"A": ["机翼", "影响", "1.5%", "x"], "B": ["机翼", " 副翼"], "NUMERIC_VALUE": ["五米"]}
    return files.vocabulary_of(spark, types).select("term", "etype")


def _exported(spark, d):
    path = fresh_path(spark, "result")
    edges = commerce_edges(spark, d).withColumns({"trigger": F.lit("t,\"q\""), "source": F.lit("table"), "chapter": F.lit(""), "sentence": F.concat("head", F.lit("\n"), "tail")})
    files.export_result(edges, path)
    return path


@equals(f"WITH {EDGES_SQL} SELECT head, relation, tail, round(score, 3) AS score, 't,\"q\"' AS \"trigger\", 'table' AS source, '' AS chapter, md5(head || chr(10) || tail) AS sentence FROM edges")
def s5_s8_triples_file(spark, d):
    return files.read_triples(spark, f"{_exported(spark, d)}/triples_meta").withColumn("sentence", F.md5("sentence")).select("head", "relation", "tail", "score", "trigger", "source", "chapter", "sentence")


@equals(f"WITH {EDGES_SQL} SELECT DISTINCT head, relation, tail FROM edges WHERE relation <> 'provides'")
def s4_keys_of_file(spark, d):
    return evaluate.keys(files.read_triples(spark, f"{_exported(spark, d)}/triples", drop_invalid=False), exclude=("provides",))


@equals(f"WITH {EDGES_SQL} SELECT head AS entity, '' AS type FROM edges UNION SELECT tail, '' FROM edges")
def s7_entities_file(spark, d):
    return files.read_entities(spark, f"{_exported(spark, d)}/entities")


@equals(f"WITH {EDGES_SQL}, e AS (SELECT head AS entity FROM edges UNION SELECT tail FROM edges) SELECT entity, row_number() OVER (ORDER BY entity) AS place FROM e")
def s9_sorted_file(spark, d):
    """A sorted sink: places of lines in the single file are those of the order by code point."""
    path = fresh_path(spark, "sorted")
    files.write_csv(merge.entities(commerce_edges(spark, d)), path, ["entity"], single=True)
    return files.read_places(spark, path).where("place > 0").select(F.col("line").alias("entity"), F.col("place").cast("long").alias("place"))


@equals("SELECT DISTINCT 'What of ' || n_name || '?' AS question FROM nation")
def s11_questions_file(spark, d):
    path = fresh_path(spark, "questions")
    asked = load(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("  What of "), "n_name", F.lit("? ")), F.lit("# a comment"), F.lit(""))).alias("value"))
    asked.write.text(path)
    return files.read_questions(spark, path)


@expect("alias:s canonical:s", ("X", "X"), ("Y", "Y"), ("x1", "X"), ("x2", "X"))
def e3_alias_file(spark, d):
    path = fresh_path(spark, "aliases")
    text = json.dumps({"_note": "x", "X": ["x1", "x2"], "Y": ["x1"]})
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return files.read_aliases(spark, f"{path}/part-*")


@expect("cleaned:s", ("ab\n",), ("甲\n乙",))
def p1_clean_text_zh(spark, d):
    return spark.createDataFrame([("a [1,2] b\r\n",), ("甲　\r 乙[3-5]",)], "t string").select(clean_text(F.col("t")).alias("cleaned"))
