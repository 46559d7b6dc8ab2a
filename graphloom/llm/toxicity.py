"""Toxicity by weak supervision.

1. From labelled training rows (a bounded sample): how often each word and word prefix occurs in documents of
   either label, summed by Spark. Those that tell the labels apart are the vocabulary; the strongest for label 1
   are cues.
2. Voters: lexicons of whole words and, for each prefix length, patterns; each votes on a document if it holds
   one of its cues. A generative model with a dependency tree estimates their accuracies and correlations by
   expectation-maximisation over vote patterns.
3. Its posterior labels train a linear classifier over the vocabulary (presence of each entry in the document).
   It scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches
from graphloom.llm.labelmodel import fit, linear
from graphloom.llm.words import _BYTE, CHUNK_BYTES, chunks, powers, segments, splitmix, word_spans

SAMPLE_ROWS = 16_000  # labelled rows that the model learns from, at most about
VOCABULARY = 4_000  # features of the model: those with most gain in the sample's whole texts
LEXICONS = 8
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)  # bytes
KINDS = 1 + len(PREFIXES)
_U = np.uint64

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_AS_SPACE = np.where(_WORD_BYTE, np.arange(256), 32).astype(np.uint8)


def text_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all distinct pairs; words are runs of letters, digits and bytes over 127, in lower case. The kind of a feature is feature % KINDS. Long texts are looked through by segments."""
    pairs = [np.zeros((0, 2), dtype=np.uint64)]
    for part, bounds, of in segments(raw, offsets, CHUNK_BYTES):
        doc, f = _features(part, bounds)
        pairs.append(np.stack([of[doc].astype(np.uint64), f], axis=1))
    if len(pairs) == 2:
        both = pairs[1]
    else:
        both = np.unique(np.concatenate(pairs), axis=0)
    return both[:, 0].astype(np.int64), both[:, 1]


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = _AS_SPACE[raw]
    starts, ends = word_spans(raw, offsets)
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    whole = splitmix((sums[ends] - sums[starts]) * inverse[starts])
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    feats = [whole[first] // _U(KINDS) * _U(KINDS)]
    of = [np.arange(len(first))]
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(e - s > n)
        at = s[long]
        feats.append(splitmix((sums[at + n] - sums[at]) * inverse[at] + _U(k)) // _U(KINDS) * _U(KINDS) + _U(k))
        of.append(long)
    flat, word = np.concatenate(feats), np.concatenate(of)
    order = np.argsort(word, kind="stable")
    flat, per = flat[order], np.bincount(word, minlength=len(first))
    begin = np.cumsum(per) - per
    pair = np.unique(doc * len(first) + back) if len(first) else np.zeros(0, dtype=np.int64)
    doc, word = (pair // len(first), pair % len(first)) if len(first) else (pair, pair)
    n = per[word]
    at = np.arange(n.sum()) + np.repeat(begin[word] - (np.cumsum(n) - n), n)
    return np.repeat(doc, n), flat[at]


def known_features(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, index in the sorted vocabulary) of all distinct pairs, in order. Long texts are looked through by segments."""
    found = []
    for part, bounds, of in segments(raw, offsets, CHUNK_BYTES):
        doc, ix = _known(part, bounds, vocabulary)
        found.append(of[doc] * max(1, len(vocabulary)) + ix)
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))


def _known(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = _AS_SPACE[raw]
    starts, ends = word_spans(raw, offsets)
    if not len(starts) or not len(vocabulary):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    whole = splitmix((sums[ends] - sums[starts]) * inverse[starts])
    docs, found = [], []
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[(vocabulary >> _U(40)).astype(np.int64) & 0xFFFF] = True
    for k, n in enumerate((0, *PREFIXES)):
        long = np.flatnonzero(ends - starts > n) if k else np.arange(len(starts))
        at = starts[long]
        f = splitmix((sums[at + n] - sums[at]) * inverse[at] + _U(k)) // _U(KINDS) * _U(KINDS) + _U(k) if k else whole // _U(KINDS) * _U(KINDS)
        maybe = np.flatnonzero(sieve[(f >> _U(40)).astype(np.int64) & 0xFFFF])
        f = f[maybe]
        ix = np.minimum(np.searchsorted(vocabulary, f), len(vocabulary) - 1)
        hit = vocabulary[ix] == f
        docs.append(doc[long[maybe[hit]]])
        found.append(ix[hit])
    pair = np.unique(np.concatenate(docs) * len(vocabulary) + np.concatenate(found))
    return pair // len(vocabulary), pair % len(vocabulary)


def _texts(batch: pa.RecordBatch, at: int):
    for a, b, raw, offsets in chunks(batch.column(at)):
        yield a, b, np.ascontiguousarray(raw), offsets


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, ix = known_features(raw, offsets, self.vocabulary)
        z = np.bincount(doc, self.weights[ix], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from training rows: those of docs(doc_id, text) with labels(doc_id, toxic) and crc32(doc_id) mod 5 not 0. Without rows of both labels every score is the base rate."""
    small_batches(docs.sparkSession)
    truth = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Rows are picked by identifier and text before they meet their labels, and repeated ones stand once: no identifier, however frequent, makes the sample larger.
    n = docs.groupBy("doc_id").agg(F.count("*").alias("n")).join(truth, "doc_id").agg(F.sum("n").alias("n")).first()["n"] or 0
    share = min(1.0, sample_rows / max(1, n))
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).where(~held_out()).dropDuplicates()
    sample = cut(picked.join(truth, "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b, raw, offsets in _texts(batch, 0):
                doc, f = text_features(raw, offsets)
                key, back = np.unique(f, return_inverse=True)
                mine = y[a:b][doc]
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.bincount(back, mine, len(key)).astype(np.int64)), pa.array(np.bincount(back, 1 - mine, len(key)).astype(np.int64))], names=["f", "n1", "n0"])

    total = sample.agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).first()
    t1, t0 = total["n1"] or 0, total["n0"] or 0
    if not t1 or not t0:
        p = (t1 + 0.5) / (t1 + t0 + 1) if t1 + t0 else 0.5
        return ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    summed = sample.select("text", "toxic").mapInArrow(count, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 >= 3")
    p1, p0 = (F.col("n1") + 0.5) / (t1 + 1.0), (F.col("n0") + 0.5) / (t0 + 1.0)
    gain = F.col("n1") * F.log(p1 / p0) + (F.lit(t1) - F.col("n1")) * F.log((1 - p1) / (1 - p0))
    top = summed.withColumns({"gain": F.round(gain, 6), "odds": F.log(p1 / p0)}).where("gain > 0").orderBy(F.desc("gain"), "f").limit(VOCABULARY).collect()
    vocabulary = np.sort(np.array([r["f"] for r in top], dtype=np.int64).view(np.uint64))
    kind = (vocabulary % _U(KINDS)).astype(int)
    cues = {np.int64(r["f"]).view(np.uint64): k for k, r in enumerate(top) if r["odds"] > 2.5 and r["n1"] >= 4}
    #: Voter of each vocabulary entry: lexicons of words by rank, a pattern voter for each prefix length; -1 without a vote.
    voter = np.array([-1 if f not in cues else cues[f] % LEXICONS if k == 0 else LEXICONS - 1 + k for f, k in zip(vocabulary, kind, strict=True)], dtype=np.int64)
    voters = LEXICONS + len(PREFIXES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in _texts(batch, 1):
                doc, ix = known_features(raw, offsets, vocabulary)
                bound = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bound), pa.array(ix.astype(np.int32)))], names=["doc_id", "ix"])

    rows = sample.select("doc_id", "text").mapInArrow(look, "doc_id long, ix array<int>").orderBy("doc_id", "ix").collect()  # about sample_rows
    features = [np.array(r["ix"], dtype=np.int64) for r in rows]
    votes = np.zeros((len(rows), voters), dtype=np.int64)
    for i, ix in enumerate(features):
        v = voter[ix]
        votes[i, v[v >= 0]] = 1
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    back = back.ravel()
    first = 1 - 0.95 * 0.35 ** patterns.sum(axis=1)
    model = fit(patterns, counts.astype(float), np.clip(first, 0.02, 0.98), 2, tree=True)
    target = model.posterior(patterns)[back]
    weights, bias = linear(features, [np.ones(len(f)) for f in features], target, len(vocabulary), l2=3e-4)
    return ToxicityModel(vocabulary, weights, bias)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; null and empty texts get the score of a text without features. A null doc_id isn't held out. Rows that repeat are scored each; an empty table gives no rows; other columns aren't read."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in _texts(batch, 2):
                s = model.scores(raw, offsets)
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
