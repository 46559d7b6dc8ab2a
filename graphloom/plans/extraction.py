"""Text to knowledge graph, evaluation of a graph, and question answering: the operators as whole plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH, Pack
from graphloom.operators import dependency, evaluate, mentions, merge, preprocess, questions, relations
from graphloom.sources.shared import written


@dataclass(frozen=True)
class ExtractionConfig:
    pack: Pack = ZH
    max_window: int = 30
    neighbours: int = 6
    gate: float = 0.30  # score under which a trigger's triple isn't made at all
    min_score: float = 0.55  # score that an edge needs after the merge
    numeric: bool = True
    codes: bool = True
    patterns: bool = True
    chapters: bool = True
    types: bool = True
    min_chapter_mentions: int = 2
    chapter_types: tuple[str, ...] = ()
    annotator: Callable[[DataFrame], DataFrame] | None = None  # adds tokens to sentences; without it there are no dependency triples
    dependency_rules: tuple[str, ...] = ("svo", "dep")
    client: Callable[[str, list[dict]], str] | None = None  # of a chapter's text and some of its edges, to a reply


class Extraction(NamedTuple):
    sentences: DataFrame
    mentions: DataFrame
    candidates: DataFrame
    edges: DataFrame
    entities: DataFrame
    statistics: DataFrame


def extract(docs: DataFrame, vocabulary: DataFrame, config: ExtractionConfig = ExtractionConfig()) -> Extraction:
    """docs(doc_id, text) and vocabulary(term, etype) to edges. Mentions are found once; scores are gated before the merge, filtered after it; observed entities come from all candidates, filtered or not."""
    pack = config.pack
    sents = preprocess.document_sentences(preprocess.spread(docs), pack)
    mentioned = mentions.with_mentions(sents, vocabulary, pack, config.numeric, config.codes).persist()
    flat = mentions.exploded(mentioned)
    parts = [relations.trigger_triples(mentioned, pack, config.max_window, config.gate, config.neighbours)]
    terms = mentions.shared_terms(docs.sparkSession, vocabulary)
    if terms is None and (config.annotator or pack.patterns or pack.numeric):
        raise ValueError(f"pattern, numeric and dependency rules take {mentions.MOST_TERMS} terms at most")
    if config.patterns and (pack.patterns or pack.pair_patterns):
        parts.append(relations.pattern_triples(sents, terms, pack))
    if config.numeric and pack.numeric:
        parts.append(relations.numeric_triples(sents, terms, pack))
    if config.annotator:
        parsed = config.annotator(sents)
        parts += [dependency.dependency_triples(parsed, terms, pack, rule, config.gate) for rule in config.dependency_rules]
    if config.chapters:
        parts.append(relations.chapter_triples(flat, vocabulary, config.min_chapter_mentions, list(config.chapter_types) or None))
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    if config.types:
        candidates = written(candidates, "candidates")  # observed entities and the merge both read them: found once
        observed = merge.entities(candidates).union(relations.cooccurring(flat, vocabulary, pack)).distinct()
        candidates = candidates.unionByName(relations.type_triples(observed, vocabulary, pack))
    edges = merge.merge_triples(candidates).where(F.col("score") >= config.min_score)
    if config.client:
        from graphloom.operators.curate import enhanced

        edges = enhanced(edges, config.client, sents)
    else:
        edges = merge.polished(edges)
    return Extraction(sents, flat, candidates, edges, merge.entities(edges), merge.statistics(edges))


class Evaluation(NamedTuple):
    levels: DataFrame
    partial: DataFrame
    relations: DataFrame
    macro: DataFrame
    confusions: DataFrame
    outcomes: DataFrame


def evaluate_graph(pred: DataFrame, gold: DataFrame, pack: Pack = ZH, aliases: DataFrame | None = None, chapter: str | None = None, include_global: bool = True, exclude: tuple[str, ...] = (), top: int = 15) -> Evaluation:
    how = {"pack": pack, "aliases": aliases, "chapter": chapter, "include_global": include_global, "exclude": exclude}
    p, g = evaluate.keys(pred, **how).persist(), evaluate.keys(gold, **how).persist()
    rows = evaluate.by_relation(p, g, top)
    return Evaluation(evaluate.levels(p, g), evaluate.partial_prf(p, g), rows, evaluate.macro_f1(rows), evaluate.confusions(p, g), evaluate.marked(p, g, evaluate.KEY))


def answer(asked: DataFrame, edges: DataFrame, sentences: DataFrame | None = None, pack: Pack = ZH, rewrite: Callable[[str], str] | None = None, max_hops: int = 3) -> DataFrame:
    """asked(qid, question) to (qid, answer, note, related), all questions at once."""
    edges = edges.persist()  # look-ups and paths name them many times: the plan would hold each
    parsed = questions.parse_questions(asked, merge.entities(edges), pack).persist()
    rows = questions.retrieve(parsed, edges, max_hops).persist()
    quotes = questions.evidence(parsed, sentences) if sentences is not None else None
    return questions.answers_text(parsed, rows, quotes, rewrite, pack, questions.related_triples(parsed, edges, rows))
