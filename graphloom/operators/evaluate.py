"""Predicted against gold triples: precision, recall and F1 at several levels."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.pack import GLOBAL_RELATIONS, ZH, Pack
from graphloom.functions.text import strip
from graphloom.sources.shared import written

KEY = ["head", "relation", "tail"]


def in_chapter(keyword: str, include_global: bool = True) -> Column:
    """Chapter holds the keyword; rows without chapter count for relations that hold everywhere."""
    everywhere = (F.col("chapter") == "") & F.col("relation").isin(list(GLOBAL_RELATIONS)) & F.lit(include_global)
    return F.contains(F.col("chapter"), F.lit(keyword)) | everywhere


def normalize_relation(c: Column, pack: Pack = ZH) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    if not pack.relation_names:
        return c
    names = F.create_map(*(F.lit(x) for kv in pack.relation_names.items() for x in kv))
    return F.coalesce(names[c], c)


def canonical(triples: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Ends replaced by their canonical names. aliases: alias, canonical (one row an alias)."""
    if aliases is None:
        return triples
    out = triples
    for end in ("head", "tail"):
        out = out.join(aliases.select(F.col("alias").alias(end), F.col("canonical").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out.select(*triples.columns)


def keys(triples: DataFrame, pack: Pack = ZH, aliases: DataFrame | None = None, chapter: str | None = None, include_global: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The distinct (head, relation, tail) to evaluate: in the chapter, relation and names normalised, without empty or equal ends and excluded relations."""
    t = triples.withColumns({"head": strip(F.coalesce("head", F.lit(""))), "tail": strip(F.coalesce("tail", F.lit(""))), "relation": normalize_relation(F.col("relation"), pack)})
    if chapter and "chapter" in t.columns:
        t = t.where(in_chapter(chapter, include_global))
    t = canonical(t.select(*KEY), aliases).where("head <> '' and tail <> '' and relation <> '' and head <> tail")
    return (t.where(~F.col("relation").isin(list(exclude))) if exclude else t).distinct()


def _ratios(df: DataFrame) -> DataFrame:
    """precision, recall, f1 of tp, n_pred, n_gold; 1 if both sets are empty, 0 where nothing divides."""
    p = F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    r = F.when((F.col("n_pred") == 0) & (F.col("n_gold") == 0), 1.0).when(F.col("n_gold") == 0, 0.0).otherwise(F.col("tp") / F.col("n_gold"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def marked(pred: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """Every key of either side with outcome tp, fp or fn: one full outer join."""
    p, g = pred.select(*on).distinct().withColumn("p", F.lit(True)), gold.select(*on).distinct().withColumn("g", F.lit(True))
    both = p.join(g, on, "full")
    return both.select(*on, F.when(F.col("p").isNull(), "fn").when(F.col("g").isNull(), "fp").otherwise("tp").alias("outcome"))


def _counts(*by: str):
    n = lambda *o: F.coalesce(F.sum(F.col("outcome").isin(*o).cast("long")), F.lit(0))
    return [n("tp").alias("tp"), n("tp", "fp").alias("n_pred"), n("tp", "fn").alias("n_gold")]


def prf(pred: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    return _ratios(marked(pred, gold, on).agg(*_counts()))


def ends(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("head").alias("entity")).union(triples.select("tail")).distinct()


def levels(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """strict (all three), pair (head, tail) and entity (either end) rows."""
    rows = [("strict", prf(pred, gold, KEY)), ("pair", prf(pred, gold, ["head", "tail"])), ("entity", prf(ends(pred), ends(gold), ["entity"]))]
    out = None
    for name, df in rows:
        df = df.select(F.lit(name).alias("level"), "tp", "n_pred", "n_gold", "precision", "recall", "f1")
        out = df if out is None else out.unionByName(df)
    return out


def _near_names(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """(a, b): names of either table that are equal or hold one another (both of `least` characters then). Names meet by equality of substrings."""
    from graphloom.operators.curate import substrings

    def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
        parts = inner.where(F.length("name") >= least).select(F.col("name").alias("part"))
        longest = parts.agg(F.max(F.length("part")).alias("n")).first()["n"] or 0
        return substrings(outer.where(F.length("name") >= least).withColumnRenamed("name", "whole"), "whole", longest).join(parts, "part").distinct()

    equal = a.join(b, "name").select(F.col("name").alias("a"), F.col("name").alias("b"))
    return equal.union(within(a, b).select("part", "whole")).union(within(b, a).select("whole", "part")).distinct()


def _candidates(pred: DataFrame, gold: DataFrame, least: int) -> DataFrame:
    p, g = (x.select(F.col("relation"), F.col("head").alias(f"{s}_head"), F.col("tail").alias(f"{s}_tail")).distinct() for x, s in ((pred, "p"), (gold, "g")))
    near = lambda end: _near_names(p.select(F.col(f"p_{end}").alias("name")).distinct(), g.select(F.col(f"g_{end}").alias("name")).distinct(), least).select(F.col("a").alias(f"p_{end}"), F.col("b").alias(f"g_{end}"))
    return p.join(near("head"), "p_head").join(g, ["relation", "g_head"]).join(near("tail"), ["p_tail", "g_tail"]).select("relation", *PAIR)


PAIR = ["p_head", "p_tail", "g_head", "g_tail"]


def partial_matches(pred: DataFrame, gold: DataFrame, least: int = 2, maximum: bool = False) -> DataFrame:
    """One-to-one pairs of the same relation whose ends are equal or hold one another: relation, p_head, p_tail, g_head, g_tail.

    Greedy in the order of (exact first, predicted, gold key): in rounds, each pair goes that is the first of both its
    rows, until none is left; that is what one pass in order gives, and no relation needs one task. With `maximum` the
    most pairs possible, where a relation's pairs are one task.
    """
    edges = _candidates(pred, gold, least)
    if maximum:
        return edges.groupBy("relation").applyInPandas(_most_pairs, "relation string, p_head string, p_tail string, g_head string, g_tail string")
    ends = (["relation", "p_head", "p_tail"], ["relation", "g_head", "g_tail"])
    order = F.struct(((F.col("p_head") != F.col("g_head")) | (F.col("p_tail") != F.col("g_tail"))).alias("inexact"), *PAIR)

    left, rounds = written(edges.withColumn("o", order), "pairs"), []
    while True:
        first = left
        for k, end in enumerate(ends):
            first = first.join(left.groupBy(*end).agg(F.min("o").alias(f"o{k}")), end)
        rounds.append(written(first.where("o = o0 and o = o1").select("relation", *PAIR), "pairs"))
        for end in ends:
            left = left.join(rounds[-1].select(*end), end, "left_anti")
        left = written(left, "pairs")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _most_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A maximum matching by augmenting paths, without recursion."""
    near: dict[tuple, list[tuple]] = {}
    for a, b, c, d in pdf.sort_values(PAIR)[PAIR].itertuples(index=False):
        near.setdefault((a, b), []).append((c, d))
    taken: dict[tuple, tuple] = {}
    mine: dict[tuple, tuple] = {}
    for start in near:
        came: dict[tuple, tuple] = {}  # gold row: the predicted row that reached it
        todo, free = [start], None
        while todo and free is None:
            x = todo.pop()
            for y in near[x]:
                if y not in came:
                    came[y] = x
                    if y not in taken:
                        free = y
                        break
                    todo.append(taken[y])
        while free is not None:  # along the path each predicted row moves on, and gives up what it had
            x = came[free]
            before = mine.get(x)
            taken[free], mine[x] = x, free
            free = before
    return pd.DataFrame([(pdf["relation"].iloc[0], *x, *y) for y, x in taken.items()], columns=["relation", *PAIR])


def partial_prf(pred: DataFrame, gold: DataFrame, least: int = 2, maximum: bool = False) -> DataFrame:
    n = partial_matches(pred, gold, least, maximum).agg(F.count("*").alias("tp"))
    return _ratios(n.crossJoin(pred.agg(F.count("*").alias("n_pred"))).crossJoin(gold.agg(F.count("*").alias("n_gold"))))  # three single rows


def by_relation(pred: DataFrame, gold: DataFrame, top: int | None = 15) -> DataFrame:
    """Rows of the most frequent gold relations (ties: by name)."""
    rows = _ratios(marked(pred, gold, KEY).groupBy("relation").agg(*_counts())).where("n_gold > 0")
    return rows.orderBy(F.desc("n_gold"), "relation").limit(top) if top else rows


def macro_f1(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("f1").alias("macro_f1"))


def confusions(pred: DataFrame, gold: DataFrame, top: int | None = 12) -> DataFrame:
    """How often a pair's gold relation (the greatest, if several) is predicted as another."""
    one = gold.groupBy("head", "tail").agg(F.max("relation").alias("gold_relation"))
    wrong = pred.join(one, ["head", "tail"]).where(F.col("relation") != F.col("gold_relation"))
    rows = wrong.groupBy("gold_relation", F.col("relation").alias("pred_relation")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "gold_relation", "pred_relation").limit(top) if top else rows


def first_aliases(rows: DataFrame) -> DataFrame:
    """(alias, canonical) from rows (canonical, alias, ord): names starting with _ are left out, the first registration wins, a canonical name stands for itself."""
    own = rows.select(F.col("canonical").alias("alias"), "canonical", (F.col("ord") * 2).alias("o"))
    each = own.union(rows.select("alias", "canonical", (F.col("ord") * 2 + 1).alias("o"))).where("not startswith(canonical, '_') and alias <> ''")
    w = W.partitionBy("alias").orderBy("o")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").select("alias", "canonical")


def report(pred: DataFrame, gold: DataFrame, top: int = 15) -> str:
    """Text of all levels; collects a few summary rows."""
    line = lambda name, r: f"{name:<10} P {r['precision']:.4f} R {r['recall']:.4f} F1 {r['f1']:.4f} TP {r['tp']} of {r['n_pred']} / {r['n_gold']}"
    rows = [(r["level"], r) for r in levels(pred, gold).collect()] + [("partial", partial_prf(pred, gold).first())]
    out = [line(*x) for x in rows]
    each = by_relation(pred, gold, top).collect()
    out += [line(r["relation"], r) for r in each]
    out.append(f"macro F1 {sum(r['f1'] for r in each) / max(1, len(each)):.4f}")
    out += [f"{r['gold_relation']} -> {r['pred_relation']}: {r['n']}" for r in confusions(pred, gold).collect()]
    return "\n".join(out)
