"""Graph operators on rows whose results follow from the definitions."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH
from graphloom.functions.text import clean_text, is_pure_number, score_of
from graphloom.operators import curate, dependency, evaluate, graph, mentions, merge, preprocess, questions, relations, search
from graphloom.sources import files

TERMS = ["折叠翼", "升阻比", "机翼", "副翼", "翼展", "活动机翼", "作动器"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(t, "STRUCTURAL_COMPONENT" if "翼" in t else "PARAMETER", 0, i) for i, t in enumerate(TERMS)], "term string, etype string, etype_ord int, term_ord int")


def sentence_table(spark, *texts, chapter=""):
    return spark.createDataFrame([(1, 0, chapter, "", i, t) for i, t in enumerate(texts)], "doc_id long, paragraph_id int, chapter string, section string, sentence_id int, text string")


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text_functions(spark):
    assert value(spark, clean_text(F.lit("a [1,2] b\r\n"))) == "ab\n"
    assert [value(spark, is_pure_number(F.lit(x))) for x in ("10%", "157度", "1.5-2", "")] == [True, False, True, True]
    assert value(spark, score_of(F.lit("bad"))) == 1.0 and value(spark, score_of(F.lit("0.5"))) == 0.5


def test_paragraphs_and_sentences(spark):
    docs = spark.createDataFrame([(1, "第4章 气动\n短\n1.1 研究背景与意义内容\n甲甲甲甲甲甲甲。乙；丙丙丙丙丙丙丙！"), (2, None), (3, "")], "doc_id long, text string")
    rows = preprocess.paragraphs(docs).orderBy("paragraph_id").collect()
    assert [(r["doc_id"], r["paragraph_id"], r["chapter"], r["section"]) for r in rows] == [(1, 0, "第4章气动", ""), (1, 1, "第4章气动", "")]
    got = preprocess.sentences(preprocess.paragraphs(docs)).orderBy("sentence_id").collect()
    assert [(r["sentence_id"], r["text"]) for r in got] == [(0, "1.1研究背景与意义内容"), (1, "甲甲甲甲甲甲甲。"), (2, "丙丙丙丙丙丙丙！")]
    fixed = preprocess.paragraphs(docs, fix_sections=True).collect()
    assert [(r["chapter"], r["section"], r["text"]) for r in fixed] == [("第4章气动", "1.1研究背景与意义内容", "甲甲甲甲甲甲甲。乙；丙丙丙丙丙丙丙！")]
    assert preprocess.document_sentences(docs).collect() == preprocess.sentences(preprocess.paragraphs(docs)).collect()
    long = spark.createDataFrame([(1, "前言\n\n第 1 章 绪论\n1234\n56789\n0\n2.1 方法\n  ab\n第 1 章 绪论\nz"), (2, None)], "doc_id long, text string")
    assert [(r["label"], r["text"]) for r in preprocess.chunks(long, target=9).orderBy("chunk_id").collect()] == [("导言", "前言"), ("第 1 章 绪论 #1", "1234\n56789"), ("第 1 章 绪论 #2", "0"), ("2.1 方法", "  ab"), ("第 1 章 绪论", "z")]
    assert preprocess.chapter_texts(preprocess.paragraphs(docs), 5).first()["text"] == "1.1研究"


def test_codes_measures_and_overlaps():
    match = mentions.matcher([], ZH)
    assert match("的F-111飞机") == [] and [m[0] for m in match("（F-111）")] == ["F-111"]
    assert [m[0] for m in match("长5mm")] == ["5m"] and [m[0] for m in match("约5-10m")] == ["5-10m"]
    assert [m[1:3] for m in mentions.dedup_overlap([("a", 0, 3, ""), ("b", 2, 6, ""), ("c", 5, 7, "")])] == [(0, 3), (2, 6)]


def triggers(spark, vocab, *texts, gate=0.30):
    found = mentions.with_mentions(sentence_table(spark, *texts), vocab)
    return {(r["head"], r["relation"], r["tail"]): r["score"] for r in relations.trigger_triples(found, min_score=gate).collect()}


def test_trigger_scores(spark, vocab):
    assert triggers(spark, vocab, "折叠翼改善升阻比")[("折叠翼", "improves", "升阻比")] == pytest.approx(0.86)
    assert triggers(spark, vocab, "折叠翼不改善升阻比")[("折叠翼", "improves", "升阻比")] == pytest.approx(0.45)
    assert triggers(spark, vocab, "折叠翼不改善升阻比", gate=0.55) == {}
    assert triggers(spark, vocab, "机翼包括副翼")[("机翼", "has_part", "副翼")] == pytest.approx(0.71)
    assert triggers(spark, vocab, "翼展不超过20m")[("翼展", "less_than", "20m")] == pytest.approx(0.59)


def test_patterns_and_quantities(spark, vocab):
    one = lambda df: {(r["head"], r["relation"], r["tail"]): r["score"] for r in df.collect()}
    assert one(relations.pattern_triples(sentence_table(spark, "活动机翼由作动器驱动副翼"), TERMS)) == {("活动机翼", "driven_by", "副翼"): 0.82}
    assert one(relations.pattern_triples(sentence_table(spark, "机翼与副翼连接"), TERMS)) == {("机翼", "connected_to", "副翼"): 0.85}
    got = one(relations.pattern_triples(sentence_table(spark, "机翼包括副翼、折叠翼，作动器"), TERMS))
    assert set(got) == {("机翼", "has_part", t) for t in ("副翼", "折叠翼", "作动器")}
    assert one(relations.numeric_triples(sentence_table(spark, "翼展不超过20m"), TERMS)) == {("翼展", "has_value", "20m"): 0.78, ("翼展", "less_than_value", "20m"): 0.78}


def test_dependencies(spark):
    tokens = [(0, "机翼", "NOUN", "nsubj", 1), (1, "采用", "VERB", "ROOT", 1), (2, "副翼", "NOUN", "dobj", 1)]
    schema = "doc_id long, chapter string, sentence_id int, text string, tokens array<struct<i:int,text:string,pos:string,dep:string,head:int>>"
    parsed = spark.createDataFrame([(1, "", 0, "机翼采用副翼", tokens), (1, "", 1, "", None)], schema)
    for rule in ("svo", "dep"):
        assert [(r["head"], r["relation"], r["tail"]) for r in dependency.dependency_triples(parsed, TERMS, rule=rule).collect()] == [("机翼", "uses_method", "副翼")]
    assert value(spark, relations.normalize_predicate(F.lit("被研制出"))) == "manufactures"
    assert value(spark, relations.normalize_predicate(F.lit("跑"))) == "related_to"


def test_chapters_types_and_cooccurrence(spark, vocab):
    texts = ["折叠翼的升阻比很高"] * 13 + ["机翼机翼"] + ["副翼"]
    flat = mentions.exploded(mentions.with_mentions(sentence_table(spark, *texts, chapter="第1章"), vocab))
    got = {r["head"]: round(r["score"], 9) for r in relations.chapter_triples(flat, vocab).collect()}
    assert got == {"折叠翼": 0.80, "升阻比": 0.80, "机翼": 0.59}
    typed = vocab.select("term", F.when(F.col("term") == "升阻比", "PARAMETER").otherwise("AIRCRAFT").alias("etype"))
    assert {r["entity"] for r in relations.cooccurring(flat, typed).collect()} == {"折叠翼", "升阻比"}
    seen = spark.createDataFrame([("机翼",), ("没有",)], "entity string")
    assert [(r["head"], r["tail"], r["score"]) for r in relations.type_triples(seen, vocab).collect()] == [("机翼", "结构部件", 0.92)]


def candidates(spark, *rows):
    return spark.createDataFrame([(h, r, t, trig, src, s, ch, se, 0, 0, i) for i, (h, r, t, trig, src, s, ch, se) in enumerate(rows)], "head string, relation string, tail string, trigger string, source string, score double, chapter string, sentence string, stage int, sentence_id int, ord long")


def test_merge(spark):
    same = ("a1", "r", "b1")
    got = merge.merge_triples(candidates(spark, (*same, "", "trigger", 0.7, "", "s"), (*same, "p", "pattern", 0.7, "c", "t"), (*same, "q", "pattern", 0.6, "", ""), ("10%", "r", "x", "", "s", 1.0, "", ""), ("157度", "r", "x", "", "s", 1.0, "", ""), ("w", "has_part", "5", "", "s", 1.0, "", ""), ("w", "has_value", "5", "", "s", 1.0, "", ""), ("w", "r", "w", "", "s", 1.0, "", "")))
    rows = {(r["head"], r["relation"], r["tail"]): r for r in got.collect()}
    assert set(rows) == {same, ("157度", "r", "x"), ("w", "has_value", "5")}
    r = rows[same]
    assert (r["source"], r["score"], r["trigger"], r["chapter"], r["sentence"]) == ("trigger+pattern+pattern", 0.7, "p", "c", "s")
    up = merge.merge_triples(candidates(spark, (*same, "t", "trigger", 0.71, "c", "s"), (*same, "p", "pattern", 0.82, "", "u"), (*same, "x", "trigger", 0.5, "k", "")))
    r = up.first()
    assert (r["source"], r["score"], r["trigger"], r["chapter"], r["sentence"]) == ("pattern+trigger", 0.82, "p", "k", "u")
    assert merge.merge_triples(candidates(spark, (*same, "", "s", 1.0, "", "")).limit(0)).count() == 0


def triples(spark, *rows):
    return spark.createDataFrame(list(rows), "head string, relation string, tail string")


def test_evaluation(spark):
    pred, gold = triples(spark, ("a", "r", "b"), ("a", "r", "c")), triples(spark, ("a", "r", "b"), ("d", "r", "e"), ("f", "r", "g"))
    r = evaluate.prf(pred, gold, evaluate.KEY).first()
    assert (r["precision"], r["recall"], r["f1"], r["tp"]) == (0.5, pytest.approx(1 / 3), pytest.approx(0.4), 1)
    none = pred.limit(0)
    assert tuple(evaluate.prf(none, none, evaluate.KEY).select("precision", "recall", "f1", "tp").first()) == (1.0, 1.0, 1.0, 0)
    assert evaluate.prf(none, gold, evaluate.KEY).first()["f1"] == 0.0
    part = evaluate.partial_prf(triples(spark, ("连杆", "r", "机翼"), ("A", "r", "机翼")), triples(spark, ("连杆最大扭矩", "r", "机翼"), ("AB", "r", "机翼")))
    assert part.first()["tp"] == 1
    greedy = triples(spark, ("ab", "r", "xx"), ("abc", "r", "xx")), triples(spark, ("ab", "r", "xx"), ("abcd", "r", "xx"))
    assert evaluate.partial_prf(*greedy).first()["tp"] == 2 == evaluate.partial_prf(*greedy, maximum=True).first()["tp"]
    raw = spark.createDataFrame([("x", "组成", "y", "第4章"), ("x", "instance_of", "z", ""), ("x", "causes", "z", ""), ("q", "r", "q", "第4章")], "head string, relation string, tail string, chapter string")
    names = spark.createDataFrame([("x", "X")], "alias string, canonical string")
    assert {tuple(r) for r in evaluate.keys(raw, aliases=names, chapter="第4章").collect()} == {("X", "has_part", "y"), ("X", "instance_of", "z")}
    assert "strict" in evaluate.report(pred, gold)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "r", "b", 0.9), ("b", "s", "c", 0.5), ("b", "r", "c", 0.8), ("c", "r", "d", 0.7), ("d", "r", "a", 0.6), ("e", "r", "f", 1.0)], "head string, relation string, tail string, score double")
    ends = spark.createDataFrame([("a", "c"), ("a", "f"), ("a", "a")], "source string, target string")
    got = graph.paths(edges, ends).orderBy("hops", "nodes").collect()
    assert [r["nodes"] for r in got] == [["a", "b", "c"], ["a", "d", "c"]] and got[0]["steps"][1]["relation"] == "r"
    near = graph.neighbourhood(edges, "a", 1)
    assert {(r["head"], r["tail"]) for r in near.collect()} == {("a", "b"), ("d", "a")}
    assert graph.centre(edges).first()["entity"] == "b"
    assert {r["entity"] for r in graph.frontier(edges, spark.createDataFrame([("e",)], "entity string"), 3).collect()} == {"e", "f"}


def test_search(spark):
    s = spark.createDataFrame([(3, "ab c"), (1, "a long text with b"), (2, "b"), (4, "zz")], "sid long, text string")
    ids = lambda df: [r["sid"] for r in df.collect()]
    assert ids(search.search(s, "b")) == [1, 2, 3] and ids(search.search_any(s, "zz", "b")) == [4, 1, 2, 3]
    assert ids(search.search_all(s, "a", "b")) == [1, 3] and ids(search.search_all(s)) == [] and ids(search.search_pair(s, "a", "b")) == [3, 1]
    names = spark.createDataFrame([("apple",), ("ape",), ("xyz",)], "entity string")
    assert [r["entity"] for r in search.close_matches(names, "appel").collect()] == ["apple", "ape"]


def test_intents(spark):
    ask = lambda q: value(spark, questions.intent(questions.clean_question(F.lit(q)), ZH)["intent"])
    assert ask("反馈线性化在哪章讨论") == "LOCATION" and ask("变体飞行器有哪些参数") == "LIST_INSTANCE"
    assert ask("机翼 和 气动效率 有什么关系") == "PROPERTY" and ask("请问 机翼是什么？") == "DEFINITION" and ask("你好") == "UNKNOWN"


def test_answers(spark):
    from graphloom.plans.extraction import answer

    edges = spark.createDataFrame([("机翼", "instance_of", "部件", 0.9), ("机翼", "has_part", "副翼", 0.8), ("副翼", "located_at", "后缘", 0.7)], "head string, relation string, tail string, score double")
    asked = spark.createDataFrame([(1, "机翼是什么？"), (2, "后缘和机翼的联系"), (3, "没有实体"), (4, "副翼是什么"), (5, "列举部")], "qid long, question string")
    sents = spark.createDataFrame([(1, "机翼很长"), (2, "机翼后缘有副翼")], "sid long, text string")
    rows = {r["qid"]: r for r in answer(asked, edges, sents).collect()}
    got = {k: r["answer"] for k, r in rows.items()}
    assert got[1] == "关于「机翼」是什么，知识图谱中给出的回答如下：\n  • (机翼 —instance_of→ 部件)\n\n原文佐证：\n  · [正文] 机翼很长\n  · [正文] 机翼后缘有副翼"
    assert rows[1]["related"] == ["(机翼 —has_part→ 副翼)"] and rows[1]["note"] is None
    assert got[2].startswith("「后缘」与「机翼」之间的关系：\n  • (副翼 —located_at→ 后缘)\n  • (机翼 —has_part→ 副翼)") and got[2].endswith("  · [正文] 机翼后缘有副翼")
    assert got[3].startswith("未在知识图谱与论文中找到与「没有实体」") and rows[3]["note"].startswith("没有从问题中")
    assert got[4] == "关于「副翼」是什么，知识图谱中给出的回答如下：\n  • （图谱中暂无直接三元组，请参考下方原文证据）\n\n原文佐证：\n  · [正文] 机翼后缘有副翼"


def test_answers_over_the_whole_commerce_graph(spark, tmp_path):
    from graphloom import queries

    nations = {k: f"NATION_{k}" for k in range(2)}
    suppliers = {k: (f"Supplier{k}", k % 2) for k in range(3)}
    parts = {k: (f"partname{k}", f"TYPE{k % 2}", f"Brand{k % 3}") for k in range(4)}
    items = [(s, p) for s in suppliers for p in parts for _ in range((s + p) % 3)] + [(0, 1)] * 5
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(k, n, 0) for k, n in nations.items()], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(1, "Customer1", 0)], "c_custkey long, c_name string, c_nationkey long"),
        "supplier": ([(k, *s) for k, s in suppliers.items()], "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(k, *p) for k, p in parts.items()], "p_partkey long, p_name string, p_type string, p_brand string"),
        "lineitem": (items, "l_suppkey long, l_partkey long"),
        "documents": ([(1, "nothing of note")], "doc_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    edges = [(n, "part_of", "ASIA", 1.0) for n in nations.values()] + [("Customer1", "located_at", nations[0], 0.9)]
    edges += [(s, "located_at", nations[n], 0.8) for s, n in suppliers.values()]
    edges += [e for p, t, b in parts.values() for e in ((p, "instance_of", t, 0.7), (p, "made_of", b, 0.6))]
    edges += [(suppliers[s][0], "provides", parts[p][0], min(1.0, 0.25 * items.count((s, p)))) for s, p in set(items)]
    got = {r["qid"]: r["answer"] for r in queries.q16_answers(spark, str(tmp_path)).collect()}
    for name in [*nations.values(), *(s for s, _ in suppliers.values()), *(x for p, t, _ in parts.values() for x in (p, t))]:
        mine = sorted((e for e in edges if name in (e[0], e[2])), key=lambda e: (-e[3], e[1], e[0], e[2]))
        assert got[f"{name}-4"].split("\n") == [f"图谱中关于「{name}」的关键信息汇总：", *(f"  • ({h} —{r}→ {t})" for h, r, t, x in mine[:12])]
    assert "provides" in got["Supplier0-4"]


def test_curation(spark):
    pred, gold = triples(spark, ("连杆", "r", "机翼"), ("翼", "r", "机翼")), triples(spark, ("大连杆", "r", "机翼"), ("x", "s", "y"))
    assert {tuple(r) for r in curate.align_gold(gold, pred).collect()} == {("连杆", "r", "机翼"), ("x", "s", "y")}
    more = triples(spark, ("机翼", "instance_of", "A"), ("1x", "instance_of", "A"), ("a_b", "instance_of", "A"), ("副翼", "instance_of", "B"))
    base = triples(spark, ("副翼", "instance_of", "A"))
    assert {tuple(r) for r in curate.augment_gold(base, more).collect()} == {("副翼", "instance_of", "A"), ("机翼", "instance_of", "A")}
    v = spark.createDataFrame([("折叠机翼结构设计法", "T"), ("机翼", "S"), ("很长很长很长很长的", "T")], "term string, etype string")
    assert {r["term"] for r in curate.prune_long_terms(v).collect()} == {"机翼", "很长很长很长很长的"}
    new = spark.createDataFrame([("翼梁", "S", "有翼梁"), ("翼肋", "S", "没有"), ("机翼", "S", "机翼"), ("q", "S", "q")], "term string, etype string, text string")
    assert {r["term"] for r in curate.valid_new_terms(new, v, ("S",)).collect()} == {"翼梁"}
    assert {r["term"] for r in curate.merge_terms(v, new.select("term", "etype")).collect()} >= {"翼梁", "机翼"}
    assert {(r["term"], r["etype"]) for r in curate.audit_terms(v, v.where("term = '机翼'"), v.where("length(term) = 9").select("term", F.lit("N").alias("new_type"))).collect()} == {("折叠机翼结构设计法", "N"), ("很长很长很长很长的", "N")}
    assert {(r["term"], r["etype"]) for r in curate.suggest_terms(gold, v).collect()} == {("大连杆", "CONCEPT"), ("x", "CONCEPT"), ("y", "CONCEPT")}
    found = spark.createDataFrame([("机翼", "is_a", "部件", "机翼是部件"), ("机翼", "zz", "部件", "机翼是部件"), ("机翼", "is_a", "无", "机翼")], "head string, relation string, tail string, text string")
    assert curate.discovered(found, gold, ("is_a",), 5).count() == 1
    assert value(spark, curate.lenient_json(F.lit('```json\n{"a": 1}\n```'), "a int"))["a"] == 1


def test_files(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"A": ["机翼", "影响", "1.5%", "x"], "B": ["机翼", "副翼"], "NUMERIC_VALUE": ["五米"]}, ensure_ascii=False))
    v = files.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert {(r["term"], r["etype"]) for r in files.first_types(v).collect()} == {("机翼", "A"), ("副翼", "B")}
    files.export_vocabulary(v, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == {"A": ["机翼"], "B": ["机翼", "副翼"]} == json.loads(files.pretty(v))
    (tmp_path / "t.csv").write_text("﻿头实体,关系,尾实体,score\n a ,r,b,0.5\nc,r,c,1\n,r,d,1\ne,r,f,bad\n")
    assert [(r["head"], r["score"]) for r in files.read_triples(spark, str(tmp_path / "t.csv")).collect()] == [("a", 0.5), ("e", 1.0)]
    (tmp_path / "a.json").write_text(json.dumps({"_note": "x", "X": ["x1", "x2"], "Y": ["x1"]}))
    assert {(r["alias"], r["canonical"]) for r in files.read_aliases(spark, str(tmp_path / "a.json")).collect()} == {("X", "X"), ("Y", "Y"), ("x1", "X"), ("x2", "X")}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.txt").write_bytes("机翼".encode("gbk"))
    (tmp_path / "g/b.txt").write_bytes("机翼".encode("utf-8-sig"))
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path / "g")).collect()] == ["机翼"] * 2
    (tmp_path / "q.txt").write_text("# note\n\n 什么是机翼 \n")
    assert [r["question"] for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["什么是机翼"]


def test_extraction_plan(spark, vocab, tmp_path):
    from graphloom.plans.extraction import evaluate_graph, extract

    docs = spark.createDataFrame([(1, "第1章 机翼\n机翼包括副翼。折叠翼改善升阻比。翼展不超过20m。"), (2, None)], "doc_id long, text string")
    got = extract(docs, vocab)
    edges = {(r["head"], r["relation"], r["tail"]): r for r in got.edges.collect()}
    assert edges[("机翼", "has_part", "副翼")]["source"] == "pattern" and ("折叠翼", "improves", "升阻比") in edges and ("翼展", "has_value", "20m") in edges
    assert edges[("机翼", "instance_of", "结构部件")]["score"] == 0.92
    files.export_result(got.edges, str(tmp_path / "r"))
    again = files.read_triples(spark, str(tmp_path / "r/triples_meta"))
    assert again.count() == len(edges)
    scores = evaluate_graph(again, got.edges, chapter=None)
    assert [r["f1"] for r in scores.levels.collect()] == [1.0, 1.0, 1.0]


def test_streams(spark, vocab, tmp_path):
    from graphloom.streaming.incremental import stream_candidates, windowed_counts

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "折叠翼改善升阻比。")], "doc_id long, text string").write.parquet(folder)
    pairs = stream_candidates(spark.readStream.schema("doc_id long, text string").parquet(folder), vocab)
    q = pairs.select(F.col("a.text").alias("a"), "gap", F.col("b.text").alias("b")).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("折叠翼", "改善", "升阻比")]
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'k' t union all select timestamp'2024-01-01 00:20:00', 'k'").write.parquet(str(tmp_path / "ev"))
    counts = windowed_counts(spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "ev")), "ts", "t")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["n"] for r in spark.table("counts").collect()] == [2]


def test_published_scores(spark):
    """Outcome lists (tp, fp, fn) of a published evaluation, in the folder that OUTCOME_LISTS names, give its scores again."""
    import os
    from pathlib import Path

    folder = os.environ.get("OUTCOME_LISTS")
    if not folder:
        pytest.skip("no lists")
    tp, fp, fn = (files.read_triples(spark, str(next(Path(folder).glob(f"*{x}.csv"))), drop_invalid=False).select(*evaluate.KEY) for x in ("tp", "fp", "fn"))
    pred, gold = tp.union(fp), tp.union(fn)
    got = {r["level"]: r for r in evaluate.levels(pred, gold).collect()}
    assert (got["strict"]["tp"], got["strict"]["n_pred"], got["strict"]["n_gold"]) == (437, 539, 734)
    assert [round(got["strict"][k], 4) for k in ("precision", "recall", "f1")] == [0.8108, 0.5954, 0.6866]
    assert round(got["pair"]["f1"], 4) == 0.6876 and round(got["entity"]["f1"], 4) == 0.8069
    assert evaluate.partial_prf(pred, gold, maximum=True).first()["tp"] == 441
    assert 433 <= evaluate.partial_prf(pred, gold).first()["tp"] <= 441
    assert round(evaluate.macro_f1(evaluate.by_relation(pred, gold)).first()["macro_f1"], 4) == 0.1527
