"""Mentions: all places of vocabulary terms, codes and measures in sentences, by one Arrow UDF (built-in functions give no offsets)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pack import ZH, Pack

try:
    import ahocorasick
except ImportError:  # optional
    ahocorasick = None

MENTIONS = "array<struct<text:string,start:int,end:int,etype:string>>"
#: A vocabulary of up to this many terms is sent to all executors (some tens of MB); a larger one is joined.
MOST_TERMS = 1_000_000
MOST_AUTOMATON = 200_000


def dedup_overlap(found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """In order of (start, longest first): a mention that overlaps the last kept one stays only if it is longer."""
    out: list[tuple[str, int, int, str]] = []
    for m in sorted(found, key=lambda m: (m[1], m[1] - m[2])):
        if out and m[1] < out[-1][2] and m[2] - m[1] <= out[-1][2] - out[-1][1]:
            continue
        out.append(m)
    return out


def _occurrences(terms: Iterable[str]) -> Callable[[str], list[tuple[str, int, int, str]]]:
    """All (overlapping) places of the terms of two characters or more: by an automaton where that library is there and terms aren't too many for it, else by a hash set for each length, filtered by first two characters."""
    known = {t for t in terms if len(t) >= 2}
    if ahocorasick is not None and known and len(known) <= MOST_AUTOMATON:
        automaton = ahocorasick.Automaton()
        for t in known:
            automaton.add_word(t, t)
        automaton.make_automaton()
        return lambda text: [(t, e + 1 - len(t), e + 1, "vocab") for e, t in automaton.iter(text)]
    lengths = sizes_by_start(known)
    return lambda text: [(t, i, i + n, "vocab") for i in range(len(text) - 1) for n in lengths.get(text[i : i + 2], ()) if (t := text[i : i + n]) in known]


def sizes_by_start(terms: Iterable[str]) -> dict[str, list[int]]:
    """Lengths of the terms, longest first, by their first two characters."""
    found: dict[str, set[int]] = {}
    for t in terms:
        found.setdefault(t[:2], set()).add(len(t))
    return {two: sorted(sizes, reverse=True) for two, sizes in found.items()}


def matcher(terms: Iterable[str] | Callable, pack: Pack = ZH, numeric: bool = True, codes: bool = True, dedup: bool = True) -> Callable[[str], list[tuple[str, int, int, str]]]:
    """Places of the terms (or what a function of _occurrences() finds), then of codes and of measures; overlaps told by dedup_overlap, or all in order of (start, longest first)."""
    places = terms if callable(terms) else _occurrences(terms)
    others = [(re.compile(p), kind) for p, kind in [(pack.code, "aircraft_code")] * codes + [(p, "numeric") for p in pack.measures] * numeric]

    def match(text: str) -> list[tuple[str, int, int, str]]:
        found = places(text) + [(m[0], m.start(), m.end(), kind) for p, kind in others for m in p.finditer(text)]
        if len(found) < 2:
            return found
        return dedup_overlap(found) if dedup else sorted(found, key=lambda m: (m[1], m[1] - m[2]))

    return match


def shared_terms(spark: SparkSession, vocabulary: DataFrame):
    """The distinct terms as a broadcast list, or None if there are over MOST_TERMS."""
    terms = vocabulary.select("term").where("length(term) >= 2").distinct()
    found = terms.limit(MOST_TERMS + 1).collect()
    return None if len(found) > MOST_TERMS else spark.sparkContext.broadcast([r["term"] for r in found])


def struct_lists(rows: list[list[tuple]], **fields: pa.DataType) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, without a dict for each."""
    flat = [x for row in rows for x in row]
    columns = zip(*flat) if flat else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32()), structs)


def _listed(rows: list[list[tuple[str, int, int, str]]]) -> pa.Array:
    return struct_lists(rows, text=pa.string(), start=pa.int32(), end=pa.int32(), etype=pa.string())


def _finder(terms, pack: Pack, numeric: bool, codes: bool, dedup: bool):
    """Arrow UDF text -> mentions over a broadcast list of terms; the matcher is built once a task."""

    @F.arrow_udf(MENTIONS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = matcher(terms.value, pack, numeric, codes, dedup)
        for s in texts:
            yield _listed([match(t or "") for t in s.to_pylist()])

    return find.asNondeterministic()  # it isn't, but so it runs once: a generator over it would filter by another call


def held_terms(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """key and held, the terms (in no order) that texts(key, text) hold, for any number of terms; keys without one are left out.

    A text's substrings of the lengths that terms with the same first two characters have meet the terms by equality:
    rows are in proportion to the texts, however many terms begin alike.
    """
    terms = vocabulary.select("term").where("length(term) >= 2").distinct()
    starts = terms.groupBy(F.substring("term", 1, 2).alias("two")).agg(F.collect_set(F.length("term")).alias("sizes")).collect()  # as many as pairs of characters
    sizes = texts.sparkSession.sparkContext.broadcast({r["two"]: sorted(r["sizes"], reverse=True) for r in starts})

    @F.arrow_udf("array<string>")
    def candidates(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = sizes.value
        for s in texts:
            yield pa.array([list({t[i : i + n] for i in range(len(t) - 1) for n in of.get(t[i : i + 2], ()) if i + n <= len(t)}) if t else [] for t in s.to_pylist()], pa.list_(pa.string()))

    hit = texts.select("key", F.explode(candidates.asNondeterministic()("text")).alias("term")).join(terms, "term")
    return hit.groupBy("key").agg(F.collect_set("term").alias("held"))


def _by_join(sentences: DataFrame, vocabulary: DataFrame, pack: Pack, numeric: bool, codes: bool, dedup: bool) -> DataFrame:
    """The same for any number of terms: each text is matched against the terms that it holds. They meet by a hash of the text, not by a number that another run of the plan may give to another row."""

    @F.arrow_udf(MENTIONS)
    def find(texts: pa.Array, held: pa.Array) -> pa.Array:
        return _listed([matcher(h or (), pack, numeric, codes, dedup)(t or "") for t, h in zip(texts.to_pylist(), held.to_pylist())])

    texts = sentences.select(F.sha2("text", 256).alias("key"), "text")
    held = held_terms(texts.dropDuplicates(["key"]), vocabulary).select(F.col("key").alias("key_"), F.col("held").alias("held_"))
    return sentences.withColumn("key_", F.sha2("text", 256)).join(held, "key_", "left").withColumn("mentions", find.asNondeterministic()("text", "held_")).select(*sentences.columns, "mentions")


def with_mentions(sentences: DataFrame, vocabulary: DataFrame, pack: Pack = ZH, numeric: bool = True, codes: bool = True, dedup: bool = True) -> DataFrame:
    """sentences with a column mentions, in order of start. Up to MOST_TERMS terms are broadcast; more are joined."""
    terms = shared_terms(sentences.sparkSession, vocabulary)
    if terms is None:
        return _by_join(sentences, vocabulary, pack, numeric, codes, dedup)
    return sentences.withColumn("mentions", _finder(terms, pack, numeric, codes, dedup)("text"))


def exploded(mentioned: DataFrame) -> DataFrame:
    """One row per mention: the columns of the sentence, ord, mention, start, end, etype."""
    rest = [c for c in mentioned.columns if c != "mentions"]
    return mentioned.select(*rest, F.posexplode("mentions").alias("ord", "m")).select(*rest, "ord", F.col("m.text").alias("mention"), "m.start", "m.end", "m.etype")


def add_terms(vocabulary: DataFrame, more: DataFrame) -> DataFrame:
    return vocabulary.select("term").union(more.select("term")).distinct()


def mined_terms(annotated: DataFrame, stop_terms: Iterable[str] = (), min_docs: int = 2, longest: int = 28) -> DataFrame:
    """Terms from candidate spans (column spans: array<string>, of an annotator): counted, 2 to `longest` characters, at least min_docs sentences; longest first."""
    spans = annotated.select(F.explode(F.array_distinct("spans")).alias("term"))
    kept = spans.where(F.length("term").between(2, longest) & ~F.col("term").isin(list(stop_terms)))
    return kept.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).orderBy(F.desc(F.length("term")), "term")
