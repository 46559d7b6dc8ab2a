"""MinHash near-duplicates with sequential Bayesian verification.

Documents are told apart by identifier and text. Those with equal shingle sets are one class, which its smallest
document stands for; classes are numbered in the order of these. Classes are
banded (32 bands of 4 minimum hashes: a pair at similarity 0.75 shares none with probability 5e-6). Candidates
come in two rounds, so that a bucket of n near copies costs about n pairs and not n * n:

1. each member of a bucket with the smallest member (a hub; every band has its own);
2. in buckets with several components after round 1: members outside the most frequent one with all members of
   other components. Both sides are dealt out in chunks, so a bucket is many tasks; a task compares its rows as
   matrices and gives a spanning forest of the links it finds.

After that, any two members of a bucket are either connected or compared. Comparison is sequential: signatures
are compared 32 values at a time, and a pair is dropped once the posterior probability (uniform prior) of a
similarity of at least the threshold is under `miss`. Survivors are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, forget, free_name, small_batches
from graphloom.llm.graph import components
from graphloom.llm.runs import group_cuts, group_runs
from graphloom.llm.words import chunks, min_hashes, shingles, splitmix, unique_sets

BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
CHUNK = 1_024  # members of a bucket in one task of round 2, on either side


def least_matches(threshold: float, hashes: int, batch: int, miss: float) -> dict[int, int]:
    """After n compared hashes, the matches under which P(similarity >= threshold) < miss, with a uniform prior.

    The posterior after m matches is Beta(m + 1, n - m + 1), of which that tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


DOC = ["doc_id", "t1", "t2"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOC (identifier and two hashes of the text) and text of each row."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DOC, n_shingles, two hashes of the shingle set and its signature (null without shingles), for each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(3)):
                hashes, bound = shingles(raw, offsets)
                sets = unique_sets(hashes, bound)
                sig = min_hashes(hashes, bound, BANDS * ROWS)
                n = [len(s) for s in sets]
                sums = [np.array([np.sum(splitmix(s ^ np.uint64(seed)), dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for seed in (1, 2)]
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())], names=[*DOC, "n_shingles", "h1", "h2", "sig"])

    return _documents(docs, id_col, text_col).mapInArrow(sketch, "doc_id long, t1 long, t2 long, n_shingles long, h1 long, h2 long, sig binary")


def shingle_table(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and set (distinct shingle hashes) of the documents in wanted(id, DOC): a row for each that docs has."""
    of = wanted.select("id", *(F.col(c).alias(f"w_{c}") for c in DOC))
    every = _documents(docs, id_col, text_col)
    texts = every.join(of, every["doc_id"].eqNullSafe(of["w_doc_id"]) & (every["t1"] == of["w_t1"]) & (every["t2"] == of["w_t2"])).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(1)):
                found = unique_sets(*shingles(raw, offsets))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate([np.sort(x.view(np.int64)) for x in found])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "set"])

    return texts.mapInArrow(sets, "id long, set array<long>").dropDuplicates(["id"])


def _alive(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of signatures x and y aren't dropped; a batch of values at a time."""
    alive, matches = np.arange(max(len(x), len(y))), np.zeros(max(len(x), len(y)), dtype=np.int64)
    x, y = np.broadcast_to(x, (len(alive), x.shape[1])), np.broadcast_to(y, (len(alive), y.shape[1]))
    for n, m in least.items():
        matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def _probable(pairs: DataFrame, signed: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't drop."""
    least = least_matches(threshold, BANDS * ROWS, BATCH, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS) for c in (2, 3))
            keep = pa.array(_alive(x, y, least))
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(signed.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    sized = both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return sized.where(F.lit(100) * F.col("i") >= F.lit(round(100 * threshold)) * (F.col("n") - F.col("i"))).select("a", "b")


def _across(placed: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Links (a, b) that join components within a bucket. placed: key, band, id, c (component after round 1)."""
    most = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    chunks_of = lambda c: F.ceil(c / CHUNK).cast("int")
    most = most.where("parts > 1").select("key", "main", chunks_of(F.col("n")).alias("mc"), chunks_of(F.col("n") - F.col("in_main")).alias("oc"))
    open_ = placed.join(most, "key")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "band", "id", "c"]
    members = open_.select(*cols, spread("mc", 1).alias("mi"), every("oc").alias("oi"), F.lit(0).alias("odd"))
    odd = open_.where("c <> main").select(*cols, every("mc").alias("mi"), spread("oc", 2).alias("oi"), F.lit(1).alias("odd"))
    full = signed.select("id", "sig").join(sets, "id")
    group = ("key", "oi", "mi")
    dealt = members.unionByName(odd).join(full, "id").repartition(*group).sortWithinPartitions(*group, "odd", "id")
    least = least_matches(threshold, BANDS * ROWS, BATCH, miss)
    percent = round(100 * threshold)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in group_runs(batches, group):
            ids, comp, is_odd, band = (part.column(c).to_numpy() for c in ("id", "c", "odd", "band"))
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS)
            lists = part.column("set").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            size = np.diff(at)
            pairs: list[tuple[int, int]] = []
            cuts = group_cuts(part, group)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                m, o = a + np.flatnonzero(is_odd[a:b] == 0), a + np.flatnonzero(is_odd[a:b] == 1)
                if not len(m) or not len(o):
                    continue
                kinds, of = np.unique(comp[a:b], return_inverse=True)
                root = np.arange(len(kinds))  # of each component; flat, so that all roots are one look-up
                first = int(band[a])
                for i in o.tolist():
                    others = m[root[of[m - a]] != root[of[i - a]]]
                    if first and len(others):  # pairs that met in an earlier band are done there
                        met = (sig[others, : first * ROWS].reshape(len(others), first, ROWS) == sig[i, : first * ROWS].reshape(first, ROWS)).all(axis=2).any(axis=1)
                        others = others[~met]
                    if not len(others):
                        continue
                    others = others[_alive(sig[i : i + 1], sig[others], least)]
                    own = flat[at[i] : at[i + 1]]
                    for j in others.tolist():
                        if root[of[i - a]] == root[of[j - a]]:
                            continue
                        its = flat[at[j] : at[j + 1]]
                        where = np.minimum(np.searchsorted(own, its), len(own) - 1)
                        n = int((own[where] == its).sum())
                        if 100 * n >= percent * (size[i] + size[j] - n):
                            pairs.append((int(ids[i]), int(ids[j])))
                            root[root == root[of[i - a]]] = root[of[j - a]]
            if pairs:
                x, y = zip(*pairs, strict=True)
                yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return dealt.select(*group, "odd", "id", "c", "band", "sig", "set").mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame, threshold: float = 0.75, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: DOC, n_shingles, component_id, leader (whether the document stays of its component). An empty set's document is its own."""
    small_batches(docs.sparkSession)
    rows = cut(sketches(docs, id_col, text_col), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), *DOC)
    found = rows.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min_by("sig", place).alias("sig"), F.min(place).alias("first"))
    # Numbers in the order of first documents: a component's least class holds its least document.
    classes = cut(found.orderBy("first").select("n_shingles", "h1", "h2", "sig", *(F.col(f"first.{c}").alias(c) for c in DOC)).withColumn("id", F.monotonically_increasing_id()), "classes")
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)))
    banded = classes.select("id", F.posexplode(bands).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select("key", "hub")
    members = cut(banded.join(shared, "key"), "members")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi")
    sets = cut(shingle_table(docs, wanted, id_col, text_col), "sets")

    hubs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    linked = cut(_confirmed(_probable(hubs, classes, threshold, miss), sets, threshold), "links1")
    first = components(linked)
    placed = cut(members.select("key", "band", "id").join(first, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("c")), "placed")
    more = cut(_across(placed, classes, sets, threshold, miss), "links2")
    forget(placed, members, sets)
    final = components(linked.unionByName(more))
    forget(linked, more)

    own = classes.select("n_shingles", "h1", "h2", "id", *(F.col(c).alias(f"first_{c}") for c in DOC))
    of = own.join(final, "id", "left").select("n_shingles", "h1", "h2", "id", *(f"first_{c}" for c in DOC), F.coalesce("component", "id").alias("root"))
    member_of = of.join(classes.select(F.col("id").alias("root"), F.col("doc_id").alias("found")), "root")
    out = rows.select(*DOC, "n_shingles", "h1", "h2").join(member_of, ["n_shingles", "h1", "h2"], "left")
    empty = F.col("n_shingles") == 0
    leads = (F.col("id") == F.col("root")) & F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("t1") == F.col("first_t1")) & (F.col("t2") == F.col("first_t2"))
    return out.select(*DOC, "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("found")).alias("component_id"), (empty | leads).alias("leader"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= 100 * threshold * |union| of their sets of five-word shingles.
    component_id is the smallest identifier that links reach, kept says whether it is the row's own. Documents without
    words (null, empty, white space) have an empty set and link with nothing. Rows that repeat an identifier with
    another text are documents of their own; a row with null identifier is in its copies' component (null where none of
    them has one) and never kept. An empty table gives no rows; other columns aren't read.
    """
    out = near_groups(docs, threshold, miss, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.75, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates, all columns kept: of each component the document with the smallest identifier (nulls last; then by a hash of the text).

    Of rows that repeat both identifier and text one stays. Texts without words link with nothing and all stay. Distinct
    texts under one identifier are different documents. An empty table gives no rows.
    """
    groups = near_groups(docs, threshold, miss, id_col, text_col).where("leader")
    count = groups.groupBy(*DOC).agg(F.count("*").alias("n"), F.max("n_shingles").alias("words"))
    names = {c: free_name(f"kept_{c}", docs) for c in (*DOC, "n", "words", "a", "b")}
    verdict = count.select(*(F.col(c).alias(names[c]) for c in (*DOC, "n", "words")))
    text = F.col(text_col)
    hashed = docs.withColumns({names["a"]: F.xxhash64(text), names["b"]: F.xxhash64(F.lit(1), text)})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names["doc_id"])) & (F.col(names["a"]) == F.col(names["t1"])) & (F.col(names["b"]) == F.col(names["t2"]))
    kept = hashed.join(verdict, same)
    twice = (F.col(names["n"]) > 1) & (F.col(names["words"]) > 0)
    once, again = kept.where(~twice), kept.where(twice).dropDuplicates([names["doc_id"], names["t1"], names["t2"]])
    return once.unionByName(again).select(*docs.columns)


#: The same rows from all pairs that share a shingle, as texts (for tables without repeated identifiers).
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * m >= 75 * (p.n + q.n - m)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
g AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)
"""
