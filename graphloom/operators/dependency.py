"""Triples from dependency parses (tokens: array<struct<i,text,pos,dep,head>> of any annotator; without one there are none)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH, Pack
from graphloom.operators.relations import TermFinder, _triples, ordered_triggers, terms_of

# Dependency labels of subjects and objects, lengths and scores.
SUBJECTS = ("nsubj", "top", "nsubjpass", "csubj")
OBJECTS = ("dobj", "pobj", "iobj", "attr", "ccomp", "xcomp")
SHORTEST, LONGEST = 2, 25
BASE, KNOWN, COMPACT, LONG, NEGATED, PASSIVE = 0.72, 0.04, 0.03, -0.10, -0.20, 0.02
COPULA_VALUE, COPULA_CLASS, SVO = 0.72, 0.66, 0.62
FOUND = "array<struct<head:string,relation:string,tail:string,trigger:string,score:double>>"


class Tree:
    """A sentence's tokens by place, with the dependents of each."""

    def __init__(self, tokens):
        self.tokens = sorted(tokens, key=lambda t: t["i"])
        self.by = {t["i"]: t for t in self.tokens}
        self.kids: dict[int, list] = {}
        for t in self.tokens:
            if t["head"] != t["i"]:
                self.kids.setdefault(t["head"], []).append(t)

    def of(self, t, labels=None, side: int = 0) -> list:
        """Dependents with one of some labels, left (-1) or right (1) of t or on both sides."""
        return [x for x in self.kids.get(t["i"], []) if (labels is None or x["dep"] in labels) and (x["i"] - t["i"]) * side >= 0]

    def subtree(self, t) -> list:
        found, todo = {}, [t]
        while todo:
            x = todo.pop()
            if x["i"] not in found:
                found[x["i"]] = x
                todo += self.kids.get(x["i"], [])
        return [found[i] for i in sorted(found)]

    def above(self, t) -> Iterator:
        seen = {t["i"]}
        while (up := self.by.get(t["head"])) is not None and up["i"] not in seen:
            seen.add(up["i"])
            yield up
            t = up


class Phrases:
    """Names of noun phrases: cleaned subtrees, brought to terms of the dictionary."""

    def __init__(self, terms, pack: Pack):
        self.pack, self.finder = pack, TermFinder(terms)
        self.known = self.finder.known
        self.prepositions, self.vague = [re.compile(p) for p in pack.prepositions], [re.compile(p) for p in pack.vague_heads]
        self.quantity = re.compile(pack.quantity) if pack.quantity else None
        self.wide = re.compile(pack.own_script)

    def is_quantity(self, text: str) -> bool:
        return bool(self.quantity and self.quantity.match(text))

    def text(self, tree: Tree, t, numbers: bool = False) -> str:
        """The subtree without marks, particles, modals, leading short adverbs, and (unless wanted) plain numbers."""
        out: list[str] = []
        for x in tree.subtree(t):
            word, pos = x["text"], x["pos"]
            plain_number = pos == "NUM" and not numbers and not (len(word) >= 2 and self.wide.search(word))
            if pos == "PUNCT" or word in self.pack.particles or word in self.pack.modals or plain_number or (pos == "ADV" and len(word) <= 2 and not out):
                continue
            out.append(word)
        return "".join(out).strip().strip("".join(self.pack.particles_at_ends))

    def valid(self, text: str, numbers: bool = False) -> bool:
        return SHORTEST <= len(text) <= LONGEST and (numbers or not text.replace(".", "").isdigit()) and text not in self.pack.pronouns and text not in self.pack.generic_heads

    def name(self, text: str, numbers: bool = False) -> str | None:
        """The term that a phrase is, or the longest within that is at least half of it; a quantity where numbers are wanted."""
        for p in self.prepositions:
            text = p.sub("", text)
        text = text.strip()
        if not text or text in self.pack.pronouns or text in self.pack.generic_heads or any(p.search(text) for p in self.vague):
            return None
        best = self.finder.resolve(text)
        if best and (best == text or len(best) >= max(2, len(text) // 2)):
            return best
        return text if numbers and self.is_quantity(text) else None


def _relation_of(pack: Pack) -> Callable[[str], tuple[str, str] | None]:
    """Predicate to (relation, trigger): a trigger itself, else the longest one within."""
    triggers = ordered_triggers(pack)
    exact = {t: r for t, r in reversed(triggers)}
    return lambda word: (exact[word], word) if word in exact else next(((r, t) for t, r in triggers if t in word), None)


def _svo(terms, pack: Pack):
    finder, relation = TermFinder(terms), _relation_of(pack)

    def find(tree: Tree):
        for v in (t for t in tree.tokens if t["pos"] in ("VERB", "AUX")):
            if not (r := relation(v["text"])):
                continue
            for s in tree.of(v, SUBJECTS, -1):
                for o in tree.of(v, OBJECTS, 1):
                    h, t = (finder.resolve(x["text"]) or finder.resolve("".join(y["text"] for y in tree.subtree(x))) for x in (s, o))
                    if h and t and h != t:
                        yield h, r[0], t, v["text"], SVO

    return find


def _dep(terms, pack: Pack):
    names, relation = Phrases(terms, pack), _relation_of(pack)

    def forbidden(r: str, tail: str) -> bool:
        return r in pack.no_numeric_tail and names.is_quantity(tail)

    def negated(tree: Tree, v) -> bool:
        near = tree.of(v)
        return any(x["text"] in pack.dependency_negations for x in [*near, *(y for x in tree.of(v, side=-1) for y in tree.of(x, side=-1))])

    def score(h: str, t: str, r: str, no: bool, passive: bool) -> float:
        parts = [BASE, KNOWN * (h in names.known), KNOWN * (t in names.known), COMPACT * (2 <= len(h) <= 8 and 2 <= len(t) <= 8), LONG * (len(h) > 14 or len(t) > 14), NEGATED * no, PASSIVE * (passive and r in pack.passive_bonus)]
        return max(0.0, min(1.0, sum(parts)))

    def of_verb(tree: Tree, v):
        r, objects = relation(v["text"]), tree.of(v, OBJECTS)
        if not r or not objects:
            return
        subjects = tree.of(v, SUBJECTS) or next((s for up in tree.above(v) if (s := tree.of(up, SUBJECTS))), [])
        passive = any(x["text"] in pack.dependency_passives or x["dep"] == "nsubjpass" for x in tree.of(v))
        no = negated(tree, v)
        for s in subjects:
            left = names.text(tree, s)
            for o in objects:
                right = names.text(tree, o, numbers=True)
                if not names.valid(left) or not names.valid(right, numbers=True):
                    continue
                h, t = names.name(left), names.name(right, numbers=True)
                if h and t and h != t and not forbidden(r[0], t):
                    yield (*((t, r[0], h) if passive else (h, r[0], t)), r[1], score(h, t, r[0], no, passive))

    def of_copula(tree: Tree, cop):
        said = tree.by.get(cop["head"])
        if said is None:
            return
        right = names.text(tree, said, numbers=True)
        number = names.is_quantity(right) or any(c.isdigit() for c in right)
        r = "has_value" if number else "is_a"
        for s in tree.of(said, SUBJECTS) if right else ():
            h, t = names.name(names.text(tree, s)), names.name(right, numbers=number)
            if h and t and h != t and not forbidden(r, t):
                yield h, r, t, cop["text"], COPULA_VALUE if number else COPULA_CLASS

    def find(tree: Tree):
        for t in tree.tokens:
            if t["pos"] == "VERB":
                yield from of_verb(tree, t)
            elif t["dep"] == "cop":
                yield from of_copula(tree, t)

    return find


RULES = {"svo": _svo, "dep": _dep}


def dependency_triples(parsed: DataFrame, terms, pack: Pack = ZH, rule: str = "svo", min_score: float = 0.0) -> DataFrame:
    """Triples of sentences with a parse (null: none).

    Rule `svo`: subjects left of a verb with objects right of it, predicate normalised, score 0.62. Rule `dep`: a verb's
    subjects, or those of the nearest word above it that has some, with its objects; ends are cleaned subtrees that name
    a term or a quantity; passives swap the ends; copulas give has_value for numbers, else is_a. The score starts at
    0.72, with 0.04 for each end that is a term, 0.03 for two short ends, -0.10 for a long one, -0.20 if negated and
    0.02 for passives of some relations. The first of equal keys in a sentence counts.
    """

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = RULES[rule](terms_of(terms), pack)

        def one(tokens) -> list[dict]:
            first: dict[tuple, tuple] = {}
            for x in find(Tree(tokens if tokens is not None else [])):
                first.setdefault(x[:3], x)
            return [dict(zip(("head", "relation", "tail", "trigger", "score"), (*x[:4], round(x[4], 6)), strict=True)) for x in first.values() if x[4] >= min_score]

        for tokens in batches:
            yield tokens.map(one)

    rows = parsed.withColumn("found", run("tokens")).select("chapter", "sentence_id", F.col("text").alias("sentence"), F.posexplode("found").alias("ord", "t"))
    return _triples(rows.select("chapter", "sentence_id", "sentence", F.col("ord").cast("long").alias("ord"), "t.*"), rule)
