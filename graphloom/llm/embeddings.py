"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Equal vectors are one class with a weight.
2. On a bounded sample of classes: principal axes of the unit vectors, and rotations of them (as many as the
   tables need bits) that bring each axis close to its sign (iterative quantisation).
3. Every class is coded; its code is cut into m substrings, one table each. Two codes that differ in fewer than m
   bits share a substring for sure; at the threshold a bit differs with probability angle / pi, from which m follows
   for the wanted recall. That holds for angles seen from the origin, so the unit vectors themselves are coded: seen
   from their mean, near vectors with a common direction are far apart. Substrings have about log2(n / 64) bits, so
   buckets keep their size as n grows; a strong common direction makes them larger. Up to CHUNK classes are one
   bucket, so all pairs are compared.
4. Buckets over CHUNK classes are dealt out as pairs of chunks, first with HAMMING bits of their codes alone: a vector
   goes on only if some other of its block is within a Hamming distance that a pair at the threshold exceeds with a
   probability under 1e-6 (five standard deviations), or at most half way to that of unrelated vectors.
5. Blocks of what goes on get the original vectors and are reranked by one matrix product in double precision. A pair
   counts only in the first table where it meets. A block gives link counts and a spanning forest of its links, never
   all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, join_hot, small_batches
from graphloom.llm.graph import components
from graphloom.llm.runs import group_cuts, group_runs

SAMPLE = 20_000  # vectors that the quantiser is fitted on, at most about
RECALL = 0.985  # of pairs just at the threshold
CHUNK = 2_048
BUCKET = 64
HAMMING = 256  # bits of a code that are compared at most


def fit_rotations(x: np.ndarray, rotations: int, rounds: int = 40) -> np.ndarray:
    """The projection (columns: bits of all rotations), fitted on unit vectors x about their mean."""
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    v = (x - mean) @ axes.T
    out = []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(axes.T @ r)
    return np.concatenate(out, axis=1)


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, tables); no bits and one table where all pairs fit one block."""
    if n <= CHUNK:
        return 0, 1
    bits = min(62, max(4, round(log2(max(n, 2) / BUCKET))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - meet))


def most_differing(bits: int, threshold: float) -> int:
    """The Hamming distance over which a pair isn't reranked."""
    rate = acos(threshold) / pi
    return ceil(bits * max((rate + 0.5) / 2, rate + 5 * sqrt(rate * (1 - rate) / max(1, bits))))


def _near_codes(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which rows of codes x (64-bit words) are within `most` bits of which of y."""
    out = np.zeros((len(x), len(y)), dtype=np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out <= most


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of the links (a, b) that join what earlier ones have not."""
    parent, out = list(range(n)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[j] = i
            out.append(k)
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links join rows with cosine >= threshold, labels aside; every link that is found is exact. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do vectors of another length; rows that
    repeat a vec_id are rows of their own in n_links, and one in components. A null vec_id counts as a link, has the
    component of its vector's copies, and is never kept. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    real = F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    finite = ~F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(real, lambda x: x != 0)
    # Equal vectors are one class, 0.0 and -0.0 alike.
    real = F.transform(real, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), real.alias("v"), F.coalesce(finite, F.lit(False)).alias("ok"))
    rows = cut(rows.withColumns({"a": F.when(F.col("ok"), F.xxhash64("v")), "b": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))}), "vectors")
    classes = cut(rows.where("ok").groupBy("a", "b").agg(F.count("*").alias("w"), F.min("vec_id").alias("low"), F.any_value("v").alias("v")).withColumn("id", F.coalesce("low", F.col("a"))), "vector-classes")
    lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dims = [r["d"] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # one row per vector length
    linked = [_one_length(classes.where(F.size("v") == d), d, threshold, recall, sample) for d in dims]
    if not linked:
        return lone.withColumn("kept", F.col("vec_id").isNotNull())
    counts, edges = linked[0]
    for c, e in linked[1:]:
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    found = classes.select("a", "b", "id", "low", "w").join(counts, "id", "left").join(components(edges), "id", "left")
    told = found.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "low").alias("c"))
    out = rows.select("vec_id", "a", "b").join(told, ["a", "b"], "left")
    mine = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("c")).alias("component_id"))
    return mine.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _fitted(classes: DataFrame, n: int, d: int, rotations: int, sample: int) -> np.ndarray:
    """fit_rotations on about `sample` of the n classes with d components."""
    share = min(1.0, sample / max(1, n))
    picked = classes.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < F.lit(ceil(share * (1 << 20)))).select("a", "v").orderBy("a").limit(2 * sample).collect()
    x = np.array([r["v"] for r in picked], dtype=float).reshape(-1, d)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return fit_rotations(x if len(x) else np.eye(d), rotations)


def _one_length(classes: DataFrame, d: int, threshold: float, recall: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) link counts and (a, b) spanning links of the classes with d components."""
    n = classes.count()
    bits, tables = tables_for(n, threshold, recall)
    projection = _fitted(classes, n, d, ceil(bits * tables / d), sample) if bits else np.zeros((d, 0))
    place = np.int64(1) << np.arange(bits, dtype=np.int64)

    kind = "<f4" if dict(classes.dtypes)["v"] == "array<float>" else "<f8"
    words = -(-min(HAMMING, bits * tables) // 64)
    most = most_differing(min(HAMMING, bits * tables), threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy().reshape(-1, d)
            u = v.astype(float)
            u /= np.abs(u).max(axis=1, keepdims=True)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            b = u @ projection >= 0
            keys = np.stack([b[:, t * bits : (t + 1) * bits] @ place for t in range(tables)], axis=1)
            short = np.zeros((len(v), words * 64), dtype=bool)
            short[:, : min(HAMMING, bits * tables)] = b[:, : min(HAMMING, bits * tables)]
            packed = np.packbits(short, axis=1) if words else np.zeros((len(v), 0), dtype=np.uint8)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary()), pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * tables).astype(np.int32)), pa.array(keys.ravel()))], names=["id", "w", "v", "code", "keys"])

    coded = cut(classes.select("id", "w", "v").mapInArrow(code, "id long, w long, v binary, code binary, keys array<long>"), "codes")
    block = ("t", "key", "p", "q")
    buckets = coded.select("id", "code", F.posexplode("keys").alias("t", "key"))
    full = buckets.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = join_hot(buckets, full.select("t", "key", "n", "chunks"), ["t", "key"], "n", n * tables).withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.col("chunks").cast("long")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("id", "code", "t", "key", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk")

    def sides(chunk: np.ndarray, a: int, b: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(a, b),) * 2 if p == q else (a + np.flatnonzero(chunk[a:b] == p), a + np.flatnonzero(chunk[a:b] == q))

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in group_runs(batches, block):
            cuts = group_cuts(part, block)
            p, q, chunk = (part.column(c).to_numpy() for c in ("p", "q", "chunk"))
            x = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint64).reshape(-1, words)
            go = np.zeros(part.num_rows, dtype=bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                left, right = sides(chunk, a, b, p[a], q[a])
                for k in range(0, len(left), 256):
                    some = left[k : k + 256]
                    near = _near_codes(x[some], x[right], most)
                    if p[a] == q[a]:
                        near[np.arange(len(some)), k + np.arange(len(some))] = False
                    go[some] |= near.any(axis=1)
                    go[right] |= near.any(axis=0)
            if go.any():
                yield from part.select(["id", *block, "chunk"]).filter(pa.array(go)).to_batches()

    whole = "id long, t int, key long, p int, q int, chunk int"
    if words:
        found = dealt.repartition(*block).sortWithinPartitions(*block).select("id", *block, "chunk", "code").mapInArrow(retrieve, whole)
    else:  # one block of few vectors: all pairs are reranked
        found = dealt.select("id", *block, "chunk")
    near_ = cut(found, "retrieved")
    blocks = near_.join(coded.drop("code") if not words else coded, "id").repartition(*block).sortWithinPartitions(*block, "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part: pa.Table) -> list[pa.RecordBatch]:
            col = {c: part.column(c).to_numpy() for c in ("t", "key", "p", "q", "chunk", "id", "w")}
            cuts = group_cuts(part, block)
            v = np.frombuffer(b"".join(part.column("v").to_pylist()), dtype=kind).reshape(-1, d).astype(float)
            norm = np.linalg.norm(v, axis=1)
            odd = (norm < 1e-100) | (norm > 1e100) | ~np.isfinite(norm)
            if odd.any():
                v = v.copy()
                v[odd] /= np.abs(v[odd]).max(axis=1, keepdims=True)
                norm = np.linalg.norm(v, axis=1)
            keys = part.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            ids, ns, tos = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                t, p, q = int(col["t"][a]), int(col["p"][a]), int(col["q"][a])
                left, right = sides(col["chunk"], a, b, p, q)
                cosine = (v[left] @ v[right].T) / (norm[left][:, None] * norm[right][None, :])
                i, j = np.nonzero(cosine >= threshold)
                if p == q:
                    i, j = i[i < j], j[i < j]
                i, j = left[i], right[j]
                new = ~(keys[i, :t] == keys[j, :t]).any(axis=1) if t else np.ones(len(i), dtype=bool)
                i, j = i[new], j[new]
                if not len(i):
                    continue
                n = np.bincount(np.concatenate([i, j]) - a, np.concatenate([col["w"][j], col["w"][i]]), b - a).astype(np.int64)
                some = np.flatnonzero(n)
                ids += [col["id"][a + some]]
                ns += [n[some]]
                tos += [np.full(len(some), -1)]
                keep = _forest(i - a, j - a, b - a)
                ids += [col["id"][i[keep]]]
                ns += [np.zeros(len(keep), dtype=np.int64)]
                tos += [j[keep]]
            if not ids:
                return []
            to = np.concatenate(tos)
            return [pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns)), pa.array(col["id"][np.maximum(to, 0)], mask=to < 0)], names=["id", "n", "other"])]

        for part in group_runs(batches, block):
            yield from solve(part)

    found = cut(blocks.select(*block, "chunk", "id", "w", "v", "keys").mapInArrow(link, "id long, n long, other long"), "vector-links")
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    return counts, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))


#: The same rows from all pairs of vectors (for tables without repeated identifiers).
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.other),
g AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM g LEFT JOIN n USING (vec_id)
"""
