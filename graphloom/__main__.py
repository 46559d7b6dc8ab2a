"""python -m graphloom extract|evaluate|ask: the plans over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.functions.pack import ZH
from graphloom.operators.evaluate import report
from graphloom.plans.extraction import ExtractionConfig, answer, evaluate_graph, extract
from graphloom.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="texts and a dictionary to triples, entities and statistics")
    e.add_argument("--texts", required=True)
    e.add_argument("--dictionary", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--max-window", type=int, default=30)
    e.add_argument("--gate", type=float, default=0.30)
    e.add_argument("--min-score", type=float, default=0.55)
    v = sub.add_parser("evaluate", help="predicted against gold triples")
    v.add_argument("--pred", required=True)
    v.add_argument("--gold", required=True)
    v.add_argument("--aliases")
    v.add_argument("--chapter")
    v.add_argument("--exclude", nargs="*", default=[])
    v.add_argument("--out")
    q = sub.add_parser("ask", help="answers to a file of questions")
    q.add_argument("--triples", required=True)
    q.add_argument("--questions", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "extract":
        config = ExtractionConfig(max_window=a.max_window, gate=a.gate, min_score=a.min_score)
        files.export_result(extract(files.read_texts(spark, a.texts), files.read_vocabulary(spark, a.dictionary), config).edges, a.out)
    elif a.command == "evaluate":
        from graphloom.operators import evaluate

        how = {"pack": ZH, "aliases": files.read_aliases(spark, a.aliases) if a.aliases else None, "chapter": a.chapter, "exclude": tuple(a.exclude)}
        pred, gold = (files.read_triples(spark, x, drop_invalid=False) for x in (a.pred, a.gold))
        print(report(evaluate.keys(pred, **how), evaluate.keys(gold, **how)))
        if a.out:
            for outcome in ("tp", "fp", "fn"):
                rows = evaluate_graph(pred, gold, **how).outcomes.where(f"outcome = '{outcome}'").drop("outcome")
                files.write_csv(rows, f"{a.out}/{outcome}", ["head", "relation", "tail"])
    else:
        asked = files.read_questions(spark, a.questions).selectExpr("monotonically_increasing_id() AS qid", "question")
        for r in answer(asked, files.read_triples(spark, a.triples)).orderBy("qid").toLocalIterator():
            print(r["answer"], end="\n\n")


if __name__ == "__main__":
    main()
