"""Rows that differed from SQL, and plans that have to stay bounded as tables grow."""

import dataclasses
import re

from graphloom.functions.pack import LATIN
from graphloom.operators import mentions, merge, preprocess, questions, relations
from graphloom.sources import files, shared


def test_numbered_lines_of_the_test_tables_name_no_section(spark):
    docs = spark.createDataFrame([(1, "Kapitel.\n56.187.231.175 Keit in lich auf.\nDas ist ein Absatz.\nEs folgt noch einer.")], "doc_id long, text string")
    rows = preprocess.paragraphs(docs, LATIN).collect()
    assert [(r["paragraph_id"], r["chapter"], r["section"], r["text"]) for r in rows] == [(0, "Kapitel.", "", "Das ist ein Absatz."), (1, "Kapitel.", "", "Es folgt noch einer.")]
    named = preprocess.paragraphs(docs, dataclasses.replace(LATIN, named_sections=True)).collect()
    assert {r["section"] for r in named} == {"56.187.231.175 Keit in lich auf."}


def python_nodes(df) -> int:
    """Operators of the plan that run Python."""
    return len(re.findall(r"\w*EvalPython", df._jdf.queryExecution().optimizedPlan().toString()))


def sentence_table(spark, *texts):
    return spark.createDataFrame([(1, 0, "", "", i, t) for i, t in enumerate(texts)], "doc_id long, paragraph_id int, chapter string, section string, sentence_id int, text string")


def test_cooccurring_reads_mentions_once(spark):
    vocab = spark.createDataFrame([("kurz", "SHORT"), ("langes Wort", "LONG"), ("allein", "SHORT")], "term string, etype string")
    found = mentions.exploded(mentions.with_mentions(sentence_table(spark, "kurz und langes Wort", "allein kurz", "allein"), vocab, LATIN))
    met = relations.cooccurring(found, vocab, LATIN)
    assert {r["entity"] for r in met.collect()} == {"kurz", "langes Wort"}
    assert python_nodes(met) == 1


def test_triggers_run_python_once_for_mentions_and_once_for_gaps(spark):
    vocab = spark.createDataFrame([("Kopf", "S"), ("Tisch", "S")], "term string, etype string")
    found = relations.trigger_triples(mentions.with_mentions(sentence_table(spark, "Kopf der Tisch"), vocab, LATIN), LATIN)
    assert [(r["head"], r["relation"], r["tail"]) for r in found.collect()] == [("Kopf", "part_of", "Tisch")]
    assert python_nodes(found) == 2


def test_terms_that_begin_alike_meet_only_texts_that_hold_them(spark, monkeypatch):
    vocab = spark.createDataFrame([(f"Supplier#{i:04d}", "S") for i in range(300)] + [("Supplier#0007 Ltd", "S"), ("ab", "S")], "term string, etype string")
    texts = ["about Supplier#0007 Ltd", "Supplier#0299 and Supplier#0001", "Supplier#0300", "", None, "ab", "ab"]
    held = mentions.held_terms(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), vocab)
    assert {r["key"]: set(r["held"]) for r in held.collect()} == {0: {"ab", "Supplier#0007", "Supplier#0007 Ltd"}, 1: {"Supplier#0299", "Supplier#0001"}, 5: {"ab"}, 6: {"ab"}}
    sents = sentence_table(spark, *texts)
    sent = {r["sentence_id"]: r["mentions"] for r in mentions.with_mentions(sents, vocab, LATIN).collect()}
    monkeypatch.setattr(mentions, "MOST_TERMS", 10)
    assert {r["sentence_id"]: r["mentions"] for r in mentions.with_mentions(sents, vocab, LATIN).collect()} == sent


def test_questions_by_broadcast_and_by_join(spark, monkeypatch):
    names = spark.createDataFrame([("机翼",), ("副翼",), ("活动机翼",)], "entity string")
    asked = spark.createDataFrame([(1, "请问活动机翼是什么？", "x"), (2, "机翼和副翼的关系", "y"), (3, "副翼在哪", None), (4, None, "z")], "qid long, question string, text string")
    parsed = questions.parse_questions(asked, names)
    rows = sorted(parsed.collect())
    assert [r["entities"] for r in rows] == [["活动机翼"], ["机翼", "副翼"], ["副翼"], []] and [r["text"] for r in rows] == ["x", "y", None, "z"]
    assert python_nodes(parsed) == 1
    monkeypatch.setattr(mentions, "MOST_TERMS", 1)
    assert sorted(questions.parse_questions(asked, names).collect()) == rows


def test_related_triples_beside_every_answer(spark):
    rows = [(f"s{i}", "r" if j % 2 else "q", f"t{j}", (i * 7 + j * 3) % 10 / 10) for i in range(3) for j in range(40)]
    edges = spark.createDataFrame(rows + rows[:5], "head string, relation string, tail string, score double")
    asked = [(1, ["s1"]), (2, ["s1"]), (3, ["t5"]), (4, [])]
    parsed = spark.createDataFrame(asked, "qid long, entities array<string>")
    shown = {1: [r for r in sorted(rows, key=lambda r: (-r[3], r[1], r[0], r[2])) if r[0] == "s1"][:25], 3: [r for r in rows if r[2] == "t5"][:1]}
    answers = spark.createDataFrame([(k, i, *r) for k, rs in shown.items() for i, r in enumerate(rs)], "qid long, rank int, head string, relation string, tail string, score double")
    got = questions.related_triples(parsed, edges, answers)
    want = []
    for qid, entities in asked:
        mine = [r for r in set(rows) - set(shown.get(qid, ())) if entities and entities[0] in (r[0], r[2])]
        want += [(qid, k, *r) for k, r in enumerate(sorted(mine, key=lambda r: (r[0] != entities[0], -r[3], r[1], r[0], r[2]))[:10], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_merge_keeps_rows_of_other_sources_only(spark):
    rows = [("a", "r", "b", f"t{k}" if k else "", "trigger", s, "", f"s{k}", 0, 0, k) for k, s in enumerate((0.5, 0.9, 0.9, 0.7))] + [("a", "r", "b", "p", "pattern", 0.9, "c", "x", 1, 0, 0), ("a", "r", "b", "t9", "trigger", 0.1, "", "y", 2, 0, 0)]
    t = spark.createDataFrame(rows, "head string, relation string, tail string, trigger string, source string, score double, chapter string, sentence string, stage int, sentence_id int, ord long")
    for part in (t, t.where("source = 'trigger'")):
        items = merge.merge_triples(part)
        wanted = ("trigger+pattern+trigger", "c") if part is t else ("trigger", "")
        assert [(r["trigger"], r["source"], r["score"], r["chapter"], r["sentence"]) for r in items.collect()] == [("t1", wanted[0], 0.9, wanted[1], "s1")]
    plan = merge.merge_triples(t)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(re.findall(r"- Sort \[head", plan)) == 1


def test_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(0, 50_000, 1, 3).selectExpr("id as k", "cast(hash(id) as string) as name").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert shared.enough_partitions(table) == 4 and shared.dealt(table, "k") is table
    monkeypatch.setattr(shared, "TASK_BYTES", 100_000)
    n = shared.enough_partitions(table)
    assert n > 4 and shared.dealt(table, "k").rdd.getNumPartitions() == n
    files.write_csv(table.select("name"), f"{tmp_path}/one", ["name"], single=True)
    monkeypatch.undo()
    names = sorted(r["name"] for r in table.collect())
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        places = files.read_places(spark, f"{tmp_path}/one")
        assert spark.read.text(f"{tmp_path}/one").rdd.getNumPartitions() > 1
        assert [r["line"] for r in sorted(places.collect(), key=lambda r: r["place"])] == ["name", *names]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
