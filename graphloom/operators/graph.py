"""The knowledge graph as an edge table (head, relation, tail, score, ...): look-ups, neighbourhoods, paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["head", "relation", "tail"]


def entities(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def relations(edges: DataFrame) -> DataFrame:
    return edges.select("relation").distinct()


def out_edges(edges: DataFrame, entity: str, relation: str | None = None) -> DataFrame:
    out = edges.where(F.col("head") == entity)
    return out.where(F.col("relation") == relation) if relation else out


def in_edges(edges: DataFrame, entity: str, relation: str | None = None) -> DataFrame:
    out = edges.where(F.col("tail") == entity)
    return out.where(F.col("relation") == relation) if relation else out


def with_relation(edges: DataFrame, relation: str) -> DataFrame:
    return edges.where(F.col("relation") == relation)


def best_of_key(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best-scored of equal (head, relation, tail)."""
    return edges.withColumn("n", F.row_number().over(W.partitionBy(*by, *KEY).orderBy(F.desc("score")))).where("n = 1").drop("n")


def triples_of(edges: DataFrame, entity: str) -> DataFrame:
    """Edges out of the entity (side 0), then into it (side 1), each key once."""
    mine = edges.where((F.col("head") == entity) | (F.col("tail") == entity)).withColumn("side", (F.col("head") != entity).cast("int"))
    return best_of_key(mine)


def legend(edges: DataFrame, types: DataFrame | None = None, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """kind, name of what a graph shows: the types of its entities (types: term, etype; `_UNKNOWN_` for others) and the groups of its relations (a relation without group by its own name), once each."""
    found = entities(edges)
    typed = found.join(types.select(F.col("term").alias("entity"), "etype"), "entity", "left") if types is not None else found.withColumn("etype", F.lit(None).cast("string"))
    group = reduce(lambda out, kv: F.when(F.col("relation").isin(list(kv[1])), kv[0]).otherwise(out), reversed(list((groups or {}).items())), F.col("relation"))
    return typed.select(F.lit("type").alias("kind"), F.coalesce("etype", F.lit("_UNKNOWN_")).alias("name")).union(edges.where("relation <> ''").select(F.lit("relation"), group)).distinct()


def related(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(((F.col("head") == a) & (F.col("tail") == b)) | ((F.col("head") == b) & (F.col("tail") == a)))


def degrees(edges: DataFrame) -> DataFrame:
    """entity, degree: ends of edges at it."""
    return edges.select(F.explode(F.array("head", "tail")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))


def centre(edges: DataFrame) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "entity").limit(1)


def steps(edges: DataFrame) -> DataFrame:
    """u, v, step: for each ordered pair of neighbours its best edge (by score; forward edges first, then smallest relation)."""
    ahead = edges.select(F.col("head").alias("u"), F.col("tail").alias("v"), F.struct(*KEY, "score").alias("step"), F.lit(0).alias("back"))
    back = edges.select(F.col("tail").alias("u"), F.col("head").alias("v"), F.struct(*KEY, "score").alias("step"), F.lit(1).alias("back"))
    order = F.struct((-F.col("step.score")).alias("s"), "back", F.col("step.relation").alias("r"))
    return ahead.union(back).groupBy("u", "v").agg(F.min_by("step", order).alias("step"))


def frontier(edges: DataFrame, seeds: DataFrame, hops: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """seed, entity, depth of all entities within `hops` of each seed(entity), edges taken either way. One join and one anti-join a hop; `cut` may end the lineage of each hop (DataFrame.checkpoint, say), which many hops need."""
    links = edges.select(F.col("head").alias("u"), F.col("tail").alias("v")).union(edges.select("tail", "head")).distinct()
    seen = last = seeds.select(F.col("entity").alias("seed"), F.col("entity"), F.lit(0).alias("depth"))
    for d in range(1, hops + 1):
        near = last.join(links, last["entity"] == links["u"]).select("seed", F.col("v").alias("entity")).distinct()
        last = near.join(seen.select("seed", "entity"), ["seed", "entity"], "left_anti").withColumn("depth", F.lit(d))
        last = cut(last) if cut else last
        seen = seen.unionByName(last)
    return seen


def neighbourhood(edges: DataFrame, entity: str, hops: int = 2, max_nodes: int | None = 60, min_score: float | None = None, only: Sequence[str] = (), min_length: int = 0) -> DataFrame:
    """Edges between the entities within `hops`, after filters on score, relation and text length; of more than max_nodes entities the nearest, then smallest, stay."""
    kept = edges
    if min_score is not None:
        kept = kept.where(F.col("score") >= min_score)
    if only:
        kept = kept.where(F.col("relation").isin(list(only)))
    if min_length:
        kept = kept.where((F.length("head") >= min_length) & (F.length("tail") >= min_length))
    near = frontier(kept, edges.sparkSession.createDataFrame([(entity,)], "entity string"), hops)
    if max_nodes:
        near = near.orderBy("depth", "entity").limit(max_nodes)
    ids = near.select("entity")
    return kept.join(ids.withColumnRenamed("entity", "head"), "head", "left_semi").join(ids.withColumnRenamed("entity", "tail"), "tail", "left_semi").select(*edges.columns)


def paths(edges: DataFrame, ends: DataFrame, max_hops: int = 3, max_paths: int = 6) -> DataFrame:
    """Simple undirected paths between each pair of ends(source, target): source, target, hops, nodes, steps; per pair the first max_paths by (hops, nodes).

    Paths grow from the source; the last hop joins the target, so no path is grown to the end for nothing.
    """
    hop = steps(edges)
    grown = ends.select("source", "target", F.array("source").alias("nodes"), F.array().cast("array<struct<head:string,relation:string,tail:string,score:double>>").alias("steps")).where("source <> target")
    found = None
    for k in range(1, max_hops + 1):
        tip = grown.withColumn("u", F.element_at("nodes", -1))
        last = hop.withColumnRenamed("v", "target")
        done = tip.join(last, ["u", "target"]).select("source", "target", F.lit(k).alias("hops"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("steps", F.array("step")).alias("steps"))
        found = done if found is None else found.unionByName(done)
        if k < max_hops:
            grown = tip.join(hop, "u").where(~F.array_contains("nodes", F.col("v")) & (F.col("v") != F.col("target"))).select("source", "target", F.concat("nodes", F.array("v")).alias("nodes"), F.concat("steps", F.array("step")).alias("steps"))
    w = W.partitionBy("source", "target").orderBy("hops", "nodes")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_paths).drop("n")


def top_neighbours(edges: DataFrame, k: int = 10) -> DataFrame:
    """For every entity its k best edges either way: entity, rank, head, relation, tail, score."""
    both = edges.select(F.col("head").alias("entity"), *KEY, "score").union(edges.select(F.col("tail"), *KEY, "score"))
    w = W.partitionBy("entity").orderBy(F.desc("score"), *KEY)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def highlighted(subgraph: DataFrame, answer: DataFrame) -> DataFrame:
    """Union of keys, flagged where they are in the answer."""
    a = answer.select(*KEY).distinct().withColumn("in_answer", F.lit(True))
    return subgraph.select(*KEY).union(answer.select(*KEY)).distinct().join(a, KEY, "left").withColumn("in_answer", F.coalesce("in_answer", F.lit(False)))


def inverse_edges(edges: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """Edges of the inverse relations, where one is known."""
    names = F.create_map(*(F.lit(x) for kv in inverses.items() for x in kv))
    turned = edges.withColumn("inverse", names[F.col("relation")]).where("inverse is not null")
    return turned.select(F.col("tail").alias("head"), F.col("inverse").alias("relation"), F.col("head").alias("tail"), "score")


def relation_counts(edges: DataFrame, top: int | None = 20) -> DataFrame:
    rows = edges.groupBy("relation").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "relation").limit(top) if top else rows


def styled(edges: DataFrame, groups: dict[str, Sequence[str]], strong: float = 0.85, fair: float = 0.65) -> DataFrame:
    """With relation group, score band and the ordinal of parallel edges."""
    group = reduce(lambda out, kv: F.when(F.col("relation").isin(list(kv[1])), kv[0]).otherwise(out), reversed(list(groups.items())), F.lit("other"))
    band = F.when(F.col("score") >= strong, "strong").when(F.col("score") >= fair, "fair").otherwise("weak")
    w = W.partitionBy(F.least("head", "tail"), F.greatest("head", "tail")).orderBy(*KEY)
    return edges.withColumns({"relation_group": group, "band": band, "parallel": F.row_number().over(w) - 1})
