"""Search of a sentence table (sid, text): terms as substrings."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(sentences: DataFrame, term: str, limit: int | None = 20) -> DataFrame:
    rows = sentences.where(F.contains("text", F.lit(term))).orderBy("sid")
    return rows.limit(limit) if limit else rows


def search_any(sentences: DataFrame, *terms: str, limit: int | None = 20) -> DataFrame:
    """Sentences with any term, by the first argument that they hold, then sid."""
    place = F.coalesce(*(F.when(F.contains("text", F.lit(t)), k) for k, t in enumerate(terms))) if terms else F.lit(None).cast("int")
    rows = sentences.withColumn("arg", place).where("arg is not null").orderBy("arg", "sid")
    return rows.limit(limit) if limit else rows


def search_all(sentences: DataFrame, *terms: str, limit: int | None = 20) -> DataFrame:
    """Sentences with all terms; none without terms."""
    every = reduce(lambda a, b: a & b, (F.contains("text", F.lit(t)) for t in terms)) if terms else F.lit(False)
    rows = sentences.where(every).orderBy("sid")
    return rows.limit(limit) if limit else rows


def search_pair(sentences: DataFrame, a: str, b: str, limit: int = 10) -> DataFrame:
    """Of the first 2 * limit sentences with both, the shortest."""
    return search_all(sentences, a, b, limit=2 * limit).orderBy(F.length("text"), "sid").limit(limit)


def term_places(sentences: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """For each of a table of terms(term) the sentences that hold it (the first `limit` by sid): term, sid, n (length of the sentence); matched by the mention automaton, not by a join of all pairs. Texts don't travel."""
    from pyspark.sql import Window as W

    from graphloom.functions.pack import Pack
    from graphloom.operators.mentions import with_mentions

    terms = terms.select("term").where("length(term) >= 2")
    if terms.isEmpty():  # texts aren't read for nothing
        return sentences.select("sid", F.lit(0).alias("n"), F.lit("").alias("term")).limit(0)
    found = with_mentions(sentences.select("sid", "text"), terms, Pack(), numeric=False, codes=False, dedup=False)
    each = found.select("sid", F.length("text").alias("n"), F.explode(F.array_distinct(F.transform("mentions", lambda m: m["text"]))).alias("term"))
    if limit is None:
        return each
    return each.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy("sid"))).where(F.col("rank") <= limit)


def search_terms(sentences: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """For each of a table of terms(term) its first `limit` sentences: term, sid, text, rank."""
    return term_places(sentences, terms, limit).select("term", "sid", "rank").join(sentences.select("sid", "text"), "sid")


def close_matches(entities: DataFrame, seed: str, n: int = 6, cutoff: float = 0.4) -> DataFrame:
    """entity, ratio of the n entities most similar to seed by matching blocks (ties: greatest name first)."""

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        m.set_seq2(seed)

        def one(x: str) -> float:
            m.set_seq1(x)
            return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

        return names.fillna("").map(one)

    return entities.select("entity").distinct().withColumn("ratio", ratio("entity")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("entity")).limit(n)


def close_by_edits(entities: DataFrame, seed: str, n: int = 6) -> DataFrame:
    """entity, edits: a built-in alternative by edit distance."""
    return entities.select("entity").distinct().withColumn("edits", F.levenshtein("entity", F.lit(seed))).orderBy("edits", "entity").limit(n)
