"""Benchmark decontamination: which documents contain a test item.

A document contains an item if it holds at least 75 % of the item's set of five-word shingles. A long document's own
set would hide a short item from MinHash, so the search is over what a document shares with the whole benchmark:

1. A Bloom filter of bounded size over all item shingles reduces each document, in one pass over its text, to the
   shingles that may be in some item. False positives only make that set larger. Documents that keep fewer than
   any item would need are done.
2. Containment search partitioned by size: reduced documents and items are classed by size (powers of 2). Within a
   pair of classes the containment threshold implies a Jaccard similarity, and that the number of minimum hashes
   with which a pair at the threshold shares one with probability 1 - `miss`. Where that is no less than the set
   itself, the shingles themselves are the index.
3. Candidates are verified: exact containment of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, free_name, small_batches
from graphloom.llm.words import chunks, shingles, splitmix, unique_sets

MISS = 1e-4
MOST_BITS = 1 << 26  # of the Bloom filter: 8 MB, whatever the benchmark's size
_U = np.uint64


def _class(n):
    """k for sizes in (2 ** (k - 1), 2 ** k]."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int32)


def hashes_needed(item_class: int, doc_class: int, threshold: float, miss: float = MISS) -> int:
    """Minimum hashes for a pair of size classes; 0: no such pair can reach the threshold; -1: as many as the set has."""
    small, large, most = 2 ** (item_class - 1) + 1 if item_class else 1, 2**item_class, 2**doc_class
    if most < threshold * small:
        return 0
    jaccard = min(threshold * q / (most + (1 - threshold) * q) for q in (small, large))
    k = ceil(log(miss) / log(1 - jaccard)) if jaccard < 1 else 1
    return k if k < most / 2 else -1


def _probe(sets: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, function, value): k minimum hashes of each set, or its members if k < 0."""
    if k < 0:
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.full(sum(map(len, sets)), -1), np.concatenate(sets).view(np.int64)
    owner, values = np.repeat(np.arange(len(sets)), k), []
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for j in range(k):
        values.append(np.minimum.reduceat(splitmix(flat ^ _U(7919 * (j + 1))), at))
    return owner, np.tile(np.arange(k), len(sets)), np.stack(values, axis=1).ravel().view(np.int64)


_PROBES = "rid long, dc int, ic int, j int, value long"


def _probes(rows: DataFrame, pairs: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Probes of (rid, set): for each class of the set, those of the other sides' classes with the hashes of that pair. pairs: own class -> (dc, ic, k)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().view(np.uint64)
            sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rid, own = batch.column(0).to_numpy(), _class(np.diff(offsets))
            for c in np.unique(own):
                mine = np.flatnonzero(own == c)
                for dc, ic, k in pairs.get(int(c), ()):
                    for at in range(0, len(mine), 500):
                        some = mine[at : at + 500]
                        owner, j, value = _probe([sets[i] for i in some], k)
                        yield pa.record_batch([pa.array(rid[some[owner]]), pa.array(np.full(len(owner), dc, np.int32)), pa.array(np.full(len(owner), ic, np.int32)), pa.array(j.astype(np.int32)), pa.array(value)], names=["rid", "dc", "ic", "j", "value"])

    return rows.select("rid", "set").mapInArrow(probe, _PROBES)


def _row_id(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.coalesce(F.col(text_col), F.lit("")))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs: rid (of the document's row), doc_id, item_id, n_shared, n_item, containment.

    Sets are of five-word shingles, or of the whole text with fewer words (such an item is in documents of just those
    words). Null, empty and blank texts contain nothing and are in nothing. Rows that repeat identifier and text give
    their pairs once; a null identifier is kept. Empty tables give no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)

    def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(1)):
                sets = unique_sets(*shingles(raw, offsets))
                some = [k for k, s in enumerate(sets) if len(s)]
                if some:
                    ends = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])]).astype(np.int32)
                    yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([sets[k] for k in some]).view(np.int64)))], names=["item_id", "set"])

    raw_items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(item_sets, "item_id long, set array<long>")
    items = cut(raw_items.distinct().withColumns({"rid": F.xxhash64("item_id", "set"), "n_item": F.size("set")}), "items")
    sizes = items.groupBy("n_item").count().agg(F.sum(F.col("count") * F.col("n_item")).alias("all"), F.min("n_item").alias("low")).first()
    classes = sorted(r["c"] for r in items.select(F.ceil(F.log2("n_item")).cast("int").alias("c")).distinct().collect())  # at most 31
    bits = min(MOST_BITS, max(1 << 16, 1 << ceil(log(128 * max(1, sizes["all"] or 1), 2))))
    need = max(1, ceil(threshold * (sizes["low"] or 1) - 1e-9))
    spots = items.select(F.explode("set").alias("x")).select(F.explode(F.array(F.pmod("x", F.lit(bits)), F.pmod(F.shiftright("x", 32), F.lit(bits)))).alias("p"))
    words = spots.groupBy(F.expr("p div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))

    def join_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype("<i8").tobytes()], pa.binary())], names=["at", "bits"])

    sieve = np.zeros(bits // 64, dtype="<i8")
    for r in words.mapInArrow(join_words, "at binary, bits binary").toLocalIterator():  # MOST_BITS / 64 words at most, as a few hundred chunks
        sieve[np.frombuffer(r["at"], dtype="<i8")] = np.frombuffer(r["bits"], dtype="<i8")
    sieve = sieve.view("<u4")
    flags = docs.sparkSession.sparkContext.broadcast(np.unpackbits(sieve.view(np.uint8), bitorder="little").astype(bool) if bits <= 1 << 23 else sieve)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = flags.value
        mask = _U(bits - 1)
        has = (lambda p: table[p]) if table.dtype == bool else (lambda p: (table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1)
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(2)):
                hashes, bound = shingles(raw, offsets)
                hit = np.flatnonzero(has((hashes & mask).astype(np.int64)))
                hit = hit[has(((hashes[hit].view(np.int64) >> 32).view(np.uint64) & mask).astype(np.int64))]
                doc = np.searchsorted(bound, hit, side="right") - 1
                order = np.lexsort((hashes[hit], doc))
                doc, h = doc[order], hashes[hit][order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                doc, h = doc[new], h[new]
                n = np.bincount(doc, minlength=b - a)
                keep = n >= need
                h = h[keep[doc]] if len(doc) else h
                rows = np.flatnonzero(keep)
                if len(rows):
                    ends = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)
                    part = batch.slice(a, b - a).take(pa.array(rows))
                    yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["rid", "doc_id", "set"])

    rows = docs.select(_row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    reduced = cut(rows.mapInArrow(reduce, "rid long, doc_id long, set array<long>").dropDuplicates(["rid"]), "shared-shingles")
    pairs = [(dc, ic, k) for ic in classes for dc in range(32) if (k := hashes_needed(ic, dc, threshold, miss))]
    by_doc: dict[int, list] = {}
    by_item: dict[int, list] = {}
    for dc, ic, k in pairs:
        by_doc.setdefault(dc, []).append((dc, ic, k))
        by_item.setdefault(ic, []).append((dc, ic, k))
    present = {r["c"] for r in reduced.select(F.ceil(F.log2(F.size("set"))).cast("int").alias("c")).distinct().collect()}  # at most 31
    by_item = {ic: [x for x in of if x[0] in present] for ic, of in by_item.items()}
    on = ["dc", "ic", "j", "value"]
    near = _probes(reduced, by_doc).join(_probes(items, by_item).withColumnRenamed("rid", "item"), on).select("rid", "item").distinct()
    both = near.join(reduced, "rid").join(items.select(F.col("rid").alias("item"), "item_id", "n_item", F.col("set").alias("of_item")), "item")
    shared = both.withColumn("n_shared", F.size(F.array_intersect("set", "of_item")))
    found = shared.where(F.lit(100) * F.col("n_shared") >= F.lit(round(100 * threshold)) * F.col("n_item"))
    return found.select("rid", "doc_id", "item_id", F.col("n_shared").cast("long"), F.col("n_item").cast("long"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that contain no item, with all their columns. Null, empty and blank texts stay; of rows that repeat all go or all stay; an empty table gives no rows."""
    bad = free_name("bad_rid", docs)
    found = contained_items(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("rid").alias(bad)).distinct()
    return docs.join(found, _row_id(id_col, text_col) == F.col(bad), "left_anti")


#: The same pairs from all shingles, as texts.
SQL = f"""
WITH lowered AS (SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(text, '{WORD}') AS w FROM lowered WHERE text IS NOT NULL),
s AS (SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END AS s FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s AS d JOIN s AS i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n::BIGINT AS n_item, n_shared::DOUBLE / n::DOUBLE AS containment FROM c JOIN n ON n.id = c.item_id WHERE 100 * n_shared >= 75 * n
"""
