"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Among all document rates w (0 to `cap`) whose words add up to the target of each source, the rates of greatest
entropy against "each document once" are exponentially tilted: w = min(cap, exp(lambda_s * size / scale_s)). The
lambda of each source maximises a concave dual; its gradient and Hessian are sums over all documents, taken from
exact (source, size) counts. Each Newton step is one distributed aggregation for all sources at once, kept within
a bracket of the root. Sums are decimals, so that reruns agree.

Rates become whole copies by systematic rounding along (size class, hash): floor(rate) copies and an extra one
whenever the running sum of fractions passes a whole number. A few passes then add or take single copies of
documents no longer than what a source still lacks or has too much. Running sums are two-level (sums within
bounded parts, then over parts), so that no source needs one task. Sources with over 1 / HOT of the documents (fewer
than HOT, by arithmetic) are broadcast to them, others meet theirs by shuffle, so that no join deals a hot source to one
task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import WORD, cut, forget, free_name, join_hot

UNIT = 1 << 30
PART_ROWS = 2_000  # in a part at least; more rows have their square root in each, so that parts are few too
HOT = 1_000
STEPS_A_JOB = 4


def text_size(text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _with_source(cells: DataFrame, of: DataFrame, total: int) -> DataFrame:
    """cells joined with of (src, docs and more, one row per source) on src; no task gets all cells of a hot source, and no join makes rows that are then dropped."""
    return join_hot(cells, of, ["src"], "docs", total, HOT)


def source_targets(cells: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: src, source, source_size, target.

    Sources by code point, null last, take the weights in turn and divide `share` of all words by weight. A target
    stops at cap times its source's size; the excess goes to the others by weight until none is above: all others
    sit at one level per unit of weight, found from running sums in order of cap * size / weight. Sources without
    words have target 0.
    """
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    ordered = sums.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("src", F.lit(len(weights))).cast("int") + 1)
    full = ordered.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "src")
    rest, every = by_level.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rest)
    tried = full.withColumn("level", level)
    first = tried.withColumn("at", F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("r"), "src", "level"))).over(every)["level"]).drop("level")
    return first.select("src", "source", "source_size", "docs", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("at"))).alias("target"))


def _newton_step(state: DataFrame, hist: DataFrame, cap: float, tolerance: float) -> DataFrame:
    """One step for every source: its words and their slope at lam over all documents, then Newton's lam, or the middle of the bracket."""
    z = F.col("size") / F.col("scale")
    tilt = F.exp(F.col("lam") * z)
    words = F.col("n") * F.col("size")
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    sums = hist.join(state.select("src", "lam", "scale"), "src").groupBy("src").agg(exact(words * F.least(F.lit(float(cap)), tilt)).alias("f"), exact(F.when(tilt < cap, words * z * tilt).otherwise(F.lit(0.0))).alias("slope"))
    step = state.join(sums, "src", "left").withColumns({"f": F.coalesce("f", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})
    gap = F.when(F.col("full") | (F.col("source_size") == 0), 0.0).otherwise((F.col("f") - F.col("target")) / F.greatest("target", F.lit(1.0)))
    under = F.col("f") < F.col("target")
    newton = F.when(F.col("slope") > 0, F.col("lam") - (F.col("f") - F.col("target")) / F.col("slope"))
    step = step.withColumns({"gap": gap, "low": F.when(under, F.col("lam")).otherwise(F.col("lo")), "high": F.when(under, F.col("hi")).otherwise(F.col("lam")), "newton": newton})
    inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
    moved = F.when(F.abs("gap") <= tolerance, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
    return step.select("src", "source_size", "target", "scale", "full", moved.alias("lam"), F.col("low").alias("lo"), F.col("high").alias("hi"), "gap")


def tilts(cells: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """One row per source with lam and scale, by distributed Newton steps on the dual; `full` marks sources at their cap."""
    hist = cut(cells.where("size > 0").groupBy("src", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs"))
    state = sources.select("src", "source_size", "target", scale.alias("scale"), (F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12)).alias("full"))
    state = state.withColumns({"lam": F.lit(0.0), "lo": F.lit(-50.0) * F.col("scale"), "hi": F.lit(cap).cast("double")})
    state = cut(state.withColumn("hi", F.log("hi") * F.col("scale")), "mix-dual")
    for k in range(most_steps):
        state = _newton_step(state, hist, cap, tolerance)
        if k % STEPS_A_JOB == STEPS_A_JOB - 1:
            state = cut(state, "mix-dual")
            worst = state.agg(F.max(F.abs("gap")).alias("x")).first()["x"]
            if worst is None or worst <= tolerance:
                break
    else:
        if worst > 1e-6:
            raise RuntimeError(f"the mix is still off by {worst} of a target after {most_steps} steps")
    return state.select("src", "full", "scale", F.round("lam", 9).alias("lam"))


def _before(df: DataFrame, keys: Sequence[str], part: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """With `before`: the sum of value over earlier rows of the same keys, by part and then order, in two levels."""
    df = df.repartition(*keys, *part)  # else a join on keys alone would leave a source in one task
    sums = df.groupBy(*keys, *part).agg(F.sum(value).alias("of_part"))
    base = sums.select(*keys, *part, F.coalesce(F.sum("of_part").over(W.partitionBy(*keys).orderBy(*part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(value).over(W.partitionBy(*keys, *part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("own", own).join(base, [*keys, *part]).withColumn("before", F.col("base") + F.col("own")).drop("own", "base")


def mix_cells(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", passes: int = 3) -> DataFrame:
    """Copies for each cell of equal documents: doc_id, h (hash of text), source, size, n (rows), source_size, target, rate, copies (of all n).

    Null text has size 0 and null is a source of its own; documents without words get rate 1 and no words are
    taken from them. An empty table gives no rows. Rows that repeat are one cell and share its copies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(source_col).alias("source"), text_size(text_col).alias("size"))
    found = cut(rows.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sources = cut(source_targets(found, weights, share, cap), "mix-sources")
    total = found.count()
    parts = max(1, -(-total // max(PART_ROWS, isqrt(total))))
    # A source's number from its name: hot names by broadcast again.
    named = sources.select(F.struct(F.col("source").isNull().alias("none"), "source").alias("src"), F.col("src").alias("number"), "docs", "source_size", "target")
    marked = _with_source(found.withColumn("src", F.struct(F.col("source").isNull().alias("none"), "source")), named, total)
    cells = cut(marked.drop("src", "docs").withColumnRenamed("number", "src"), "mix-marked")
    dual = cut(tilts(cells, sources, cap).join(sources.select("src", "docs"), "src"), "mix-tilts")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    rated = _with_source(cells, dual, total).withColumn("rate", rate).drop("lam", "scale", "full", "docs")
    rated = rated.withColumns({"order": F.xxhash64("doc_id", "h"), "whole": F.floor("rate") * F.col("n"), "frac": F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long") * F.col("n"), "class": F.floor(F.log2(F.col("size") + 1) * 2).cast("int")})
    rated = rated.withColumn("part", F.pmod("order", F.lit(parts)).cast("int"))
    run = _before(rated, ["src"], ["class", "part"], ["order", "doc_id"], "frac")
    extra = F.expr(f"(before + frac + {UNIT // 2}) div {UNIT} - (before + {UNIT // 2}) div {UNIT}")
    out = cut(run.withColumn("copies", F.col("whole") + extra).drop("whole", "frac", "before", "class"), "mix-copies")
    forget(found, cells)
    for _ in range(passes):
        lack = out.groupBy("src").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("lack"), F.count("*").alias("docs"))
        room = _with_source(out, lack, total).withColumn("fits", (F.col("size") > 0) & (F.col("size") <= F.abs("lack")) & F.when(F.col("lack") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0))
        room = room.withColumn("step", F.when(F.col("fits"), F.col("size")).otherwise(F.lit(0)))
        run = _before(room, ["src"], ["part"], ["order", "doc_id"], "step")
        turn = F.col("fits") & (F.col("before") + F.col("step") <= F.abs("lack"))
        old, out = out, cut(run.withColumn("copies", F.col("copies") + F.when(turn, F.signum("lack").cast("long")).otherwise(F.lit(0))).drop("lack", "fits", "step", "before", "docs"), "mix-copies")
        forget(old)
    return out.select("doc_id", "h", "source", "size", "n", "source_size", "target", "rate", "copies")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken (words, repeats counted)."""
    cells = mix_cells(docs, **how)
    each = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    copies = F.expr("copies div n + if(k <= copies % n, 1, 0)")
    return each.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns kept.

    Rows that repeat identifier, text and source share their copies: one of them stands for all. Null texts count as
    empty, null identifiers and sources as values of their own; an empty table gives no rows.
    """
    id_col, text_col, source_col = (how.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    name = {c: free_name(f"mix_{c}", docs) for c in ("doc_id", "h", "source", "copies", "n", "hash", "k")}
    cells = mix_cells(docs, **how).where("copies > 0").select(*(F.col(c).alias(name[c]) for c in ("doc_id", "h", "source", "copies", "n")))
    hashed = docs.withColumn(name["hash"], F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = hashed[id_col].eqNullSafe(cells[name["doc_id"]]) & (hashed[name["hash"]] == cells[name["h"]]) & hashed[source_col].eqNullSafe(cells[name["source"]])
    taken = hashed.join(cells, same)
    one = F.col(name["n"]) == 1
    once, again = taken.where(one), taken.where(~one).dropDuplicates([name[c] for c in ("doc_id", "h", "source")])
    return once.unionByName(again).withColumn(name["k"], F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int")))).select(*docs.columns)
