"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low, high or nothing on every document. Counts of their vote patterns over
all documents (at most 3 ** labellers) go to expectation-maximisation, which estimates each labeller's accuracy.
The posterior labels of a bounded sample train a hashed linear scorer over word shapes and binned statistics; it
scores every whole text. No gold label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches
from graphloom.llm.labelmodel import LabelModel, fit, linear
from graphloom.llm.words import chunks, count_bytes, powers, splitmix, word_hashes, word_spans

SIZE = 1 << 12
SAMPLE_ROWS = 20_000  # expected size of the sample that the scorer is trained on
STATS = ("upper", "symbol", "pipe", "shout", "distinct", "top", "repeat", "stop")
#: Statistics are smoothed with SMOOTH words of usual prose, so that a short text isn't judged by one capital or full stop.
SMOOTH = 6
USUAL = {"upper": 0.02, "symbol": 0.025, "distinct": 0.8, "top": 0.06, "stop": 0.09}
_BINS = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_U = np.uint64

_ascii = np.arange(256)
_UPPER = (_ascii >= 65) & (_ascii <= 90)
_LETTER = _UPPER | ((_ascii >= 97) & (_ascii <= 122)) | (_ascii >= 128)
_DIGIT = (_ascii >= 48) & (_ascii <= 57)
_SPACE = (_ascii == 32) | ((_ascii >= 9) & (_ascii <= 13))
_SYMBOL = ~_LETTER & ~_DIGIT & ~_SPACE
#: For word shapes: capitals, other letters and digits are one class each; symbols stand for themselves.
_CLASS = np.where(_UPPER, 1, np.where(_LETTER, 2, np.where(_DIGIT, 3, _ascii))).astype(np.uint64)
_CLASS_HASH = splitmix(_CLASS + _U(500))


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, together: int = 1 << 17) -> np.ndarray:
    """Hashed shape of each word."""
    out = np.zeros(len(starts), dtype=np.int64)
    for a in range(0, len(starts), together):
        s, e = starts[a : a + together], ends[a : a + together]
        base = s[0]
        part, s, e = raw[base : e[-1]], s - base, e - base
        kept = ~_SPACE[part]
        kept[1:] &= _CLASS[part[1:]] != _CLASS[part[:-1]]
        kept[s] = True
        at = np.concatenate([[0], np.cumsum(kept)])
        power, inverse = powers(int(at[-1]) + 1)
        run = np.concatenate([[_U(0)], np.cumsum(_CLASS_HASH[part[kept]] * power[: at[-1]])])
        out[a : a + together] = splitmix((run[at[e]] - run[at[s]]) * inverse[at[s]]) % _U(SIZE - len(STATS) * len(_BINS))
    return out


def statistics(raw: np.ndarray, offsets: np.ndarray, featured: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, STATS of each, and the hashed features (index, value) of those flagged (all by default). Texts without words have zeros and no features."""
    featured = np.ones(len(offsets) - 1, dtype=bool) if featured is None else featured
    n = len(offsets) - 1
    starts, ends = word_spans(raw, offsets)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    sums = lambda flags: count_bytes(raw, offsets, flags)
    letters, chars = sums(_LETTER) + 5.0 * SMOOTH, sums(~_SPACE) + 5.0 * SMOOTH
    hashes = word_hashes(raw, starts, ends)
    some = words + float(SMOOTH)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][words > 0]] = False
    ends_line = np.isin(raw[ends - 1], np.frombuffer(b".?!", dtype=np.uint8)) if len(ends) else np.zeros(0, dtype=bool)
    of_words = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
    distinct, top = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(words):
        _, c = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
        distinct[i], top[i] = len(c), c.max()
    usual = {k: SMOOTH * x for k, x in USUAL.items()}
    stats = np.stack([(sums(_UPPER) + 5 * usual["upper"]) / letters, (sums(_SYMBOL) + 5 * usual["symbol"]) / chars, sums(_ascii == ord("|")) / some, np.minimum(1, sums(_ascii == ord("!")) / some), (distinct + usual["distinct"]) / some, (top + usual["top"]) / some, of_words(same) / some, (of_words(ends_line) + usual["stop"]) / some], axis=1)
    # Shapes: runs of a class within a word count once. Texts are taken a window of words at a time.
    none = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    bins = SIZE - len(STATS) * len(_BINS) + np.arange(len(STATS)) * len(_BINS) + np.searchsorted(_BINS, stats, side="right") - 1
    features = []
    shape = _shapes(raw, starts, ends) if featured.all() else None
    for i in range(n):
        if not words[i] or not featured[i]:
            features.append(none)
            continue
        mine = slice(first[i], first[i + 1])
        own = shape[mine] if shape is not None else _shapes(raw, starts[mine], ends[mine])
        ix, c = np.unique(own, return_counts=True)
        features.append((np.concatenate([ix, bins[i]]).astype(np.int32), np.concatenate([c / some[i], np.full(len(STATS), 0.5)]).astype(np.float32)))
    return words, stats, features


NONE, LOW, HIGH = 0, 1, 2


def labellers(words: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Votes of each labeller on each document: shouting capitals, symbols, table bars, exclamations, few distinct words, one dominant word, the same word in turn, and even prose (three views)."""
    upper, symbol, pipe, shout, distinct, top, repeat, stop = stats.T
    enough = words >= 8
    low = lambda c: np.where(c, LOW, NONE)
    high = lambda c: np.where(c, HIGH, NONE)
    return np.stack([
        low((upper > 0.5) & (words >= 3)), low(symbol > 0.13), low(pipe > 0.04), low(shout > 0.25), low(enough & (distinct < 0.4)), low(enough & (top > 0.3)), low(enough & (repeat > 0.2)),
        high((symbol < 0.06) & (upper < 0.15)), high((distinct > 0.55) & (repeat < 0.05)), high(enough & (stop > 0.02) & (stop < 0.3) & (top < 0.2)),
    ], axis=1).astype(np.int64)


VOTERS = 10


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(high quality) of each text; 0 without words."""
        words, _, features = statistics(raw, offsets)
        z = np.array([float(self.weights[ix] @ x) for ix, x in features]) + self.bias
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> QualityModel:
    """Votes of all documents, the label model, and the scorer trained on posteriors of a sample of about sample_rows."""
    small_batches(docs.sparkSession)
    rows = max(1, docs.count())
    share = min(1.0, sample_rows / rows)
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # Of a text's copies its share is in the sample, rounded up or down by its hash: about sample_rows in all.
    due = F.col("count") * F.lit(share)
    picks = texts.groupBy("h").count().select("h", (F.floor(due) + (F.pmod("h", F.lit(1 << 52)) / F.lit(float(1 << 52)) < due - F.floor(due)).cast("long")).alias("m")).where("m > 0")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            once = np.zeros(len(picked), dtype=bool)  # one of equal texts will do
            once[np.unique(batch.column(1).to_numpy(), return_index=True)[1]] = True
            for a, b, raw, offsets in chunks(batch.column(0)):
                words, stats, features = statistics(raw, offsets, (picked & once)[a:b])
                code = labellers(words, stats) @ (3 ** np.arange(VOTERS))
                mine = (picked & once)[a:b] & (words > 0)
                yield pa.record_batch([pa.array(code), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([ix.tobytes() if p else None for (ix, _), p in zip(features, mine, strict=True)], pa.binary()), pa.array([x.tobytes() if p else None for (_, x), p in zip(features, mine, strict=True)], pa.binary())], names=["code", "h", "m", "ix", "x"])

    voted = cut(texts.join(F.broadcast(picks), "h", "left").select("text", "h", "m").mapInArrow(vote, "code long, h long, m long, ix binary, x binary"), "votes")
    found = voted.groupBy("code").count().orderBy("code").collect()  # at most 3 ** VOTERS rows
    codes, counts = np.array([r["code"] for r in found], dtype=np.int64), np.array([r["count"] for r in found], dtype=float)
    patterns = codes[:, None] // 3 ** np.arange(VOTERS) % 3
    lows, highs = (patterns == LOW).sum(axis=1), (patterns == HIGH).sum(axis=1)
    first = np.where(lows > 0, 0.1 ** np.minimum(lows, 3) * (1 + highs), 0.6 + 0.1 * highs)
    model = fit(patterns, counts, np.clip(first, 0.001, 0.95), 3) if len(codes) else LabelModel(np.array([0.5, 0.5]), [], [])
    sample = voted.where("ix is not null").dropDuplicates(["h"]).orderBy("h").collect() if len(codes) else []
    sample = [r for r in sample for _ in range(r["m"])]
    target = model.posterior(np.array([r["code"] for r in sample], dtype=np.int64)[:, None] // 3 ** np.arange(VOTERS) % 3) if sample else np.zeros(0)
    weights, bias = linear([np.frombuffer(r["ix"], dtype=np.int32) for r in sample], [np.frombuffer(r["x"], dtype=np.float32) for r in sample], target, SIZE)
    return QualityModel(model, weights.astype(np.float32), bias)


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (P(high quality)) and keep (score >= 0.5) of each row. Null, empty and blank texts score 0; rows that repeat are scored each; an empty table gives no rows; other columns aren't read."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(1)):
                s = model.scores(raw, offsets)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s.astype(float)), pa.array(s >= 0.5)], names=["doc_id", "score", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double, keep boolean")


def good_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model keeps, with all their columns. Null, empty and blank texts go; rows that repeat all stay or all go; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.scores(raw, offsets) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
