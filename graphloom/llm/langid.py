"""Language identification with a linear-chain conditional random field over words.

States are the languages. A word's potentials sum weights of hashed features: the word itself (a learned lexicon),
affixes of 1 to 4 bytes and n-grams of 2 and 3 bytes. Transitions are learned with them, from sequences in which spans
of training documents of different languages follow one another, as in code-switched text. Forward-backward labels each
word of the whole text; a text's language has most expected words. A text over SEGMENT bytes is several sequences, cut
between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import small_batches
from graphloom.llm.toxicity import _AS_SPACE, held_out
from graphloom.llm.words import _BYTE, chunks, powers, segments, splitmix, word_spans

SIZE = 1 << 16
SAMPLE_ROWS = 300  # training documents of each language, at most
SEGMENT = 8 << 10
MOST_LANGUAGES = 100_000  # above, the column holds no languages: an error, nothing is left out
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
_U = np.uint64


def _lower(raw: np.ndarray) -> np.ndarray:
    """Letters, digits and bytes over 127 stay, the rest is space; capitals of the Latin-1 supplement in UTF-8 become small ones."""
    out = _AS_SPACE[raw]
    if len(out) > 1:
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text (one more at the end); the number of each word among the distinct ones; their features (flat, and where each word's begin)."""
    raw = _lower(raw)
    starts, ends = word_spans(raw, offsets)
    first = np.searchsorted(starts, offsets)
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    part = lambda a, b, kind: splitmix((sums[b] - sums[a]) * inverse[a] + _U(kind)) % _U(SIZE)
    _, one, back = np.unique((sums[ends] - sums[starts]) * inverse[starts], return_index=True, return_inverse=True)
    s, e = starts[one], ends[one]
    word, feats = [np.arange(len(s))], [part(s, e, 1)]
    for n in AFFIXES:
        long = np.flatnonzero(e - s >= n)
        word += [long, long]
        feats += [part(s[long], s[long] + n, 10 + n), part(e[long] - n, e[long], 20 + n)]
    for n in GRAMS:
        count = np.maximum(e - s - n + 1, 0)
        of = np.repeat(np.arange(len(s)), count)
        at = s[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        word.append(of)
        feats.append(part(at, at + n, 30 + n))
    word, flat = np.concatenate(word), np.concatenate(feats).astype(np.int64)
    order = np.argsort(word, kind="stable")
    per = np.bincount(word, minlength=len(s))
    return first, back.ravel(), flat[order], np.concatenate([[0], np.cumsum(per)])


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # SIZE x languages
    moves: np.ndarray  # log potentials, from x to

    def potentials(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of each distinct word: sums of weights over the root of their number."""
        if len(begin) < 2:
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[flat], begin[:-1], axis=0) / np.sqrt(np.diff(begin))[:, None]

    def expected(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Expected words of each language in each text, by forward-backward over all its words."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for part, bounds, of in segments(raw, offsets, SEGMENT):
            np.add.at(out, of, self._expected(part, bounds))
        return out

    def _expected(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first, word, flat, begin = words_of(raw, offsets)
        p = self.potentials(flat, begin)
        p = np.exp(p - p.max(axis=1, keepdims=True, initial=-np.inf))[word] if len(p) else np.zeros((0, len(self.langs)))
        move = np.exp(self.moves)
        n, size = len(offsets) - 1, np.diff(first)
        order = np.argsort(-size, kind="stable")
        head, sizes = first[:-1][order], size[order]
        steps = int(sizes[0]) if n else 0
        alive = np.searchsorted(-sizes, -np.arange(steps + 1), side="left")
        forward = np.empty_like(p)
        state = None
        for t in range(steps):
            at = head[: alive[t]] + t
            state = p[at] if t == 0 else (state[: alive[t]] @ move) * p[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        out = np.zeros((n, len(self.langs)))
        back = np.ones((n, len(self.langs)))
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            at = head[:k] + t
            m = forward[at] * back[:k]
            out[:k] += m / m.sum(axis=1, keepdims=True)
            b = (p[at] * back[:k]) @ move.T
            back[:k] = b / b.sum(axis=1, keepdims=True)
        result = np.empty_like(out)
        result[order] = out
        return result


def fit_crf(spans: list[tuple[str, str]], sequences: int | None = None, length: int = 48, steps: int | None = None, seed: int = 7) -> Crf:
    """Learn from (language, text): conditional likelihood of sequences that switch language, by Adam over minibatches. Sequences, steps and batches grow with the languages. Without texts, a model without languages."""
    langs = sorted({x for x, _ in spans})
    n = len(langs)
    sequences, steps, batch = sequences or max(1500, 60 * n), steps or max(240, 3 * n), max(48, n)
    if not n:
        return Crf([], np.zeros((SIZE, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    texts = [t.encode() for _, t in spans]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, word, flat, begin = words_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    place = {x: k for k, x in enumerate(langs)}
    lang = np.array([place[x] for x, _ in spans])
    usable = np.flatnonzero(np.diff(first) > 0)
    if not len(usable):
        return Crf(langs, np.zeros((SIZE, n)), np.zeros((n, n)))
    of_lang = {k: usable[lang[usable] == k] for k in np.unique(lang[usable])}
    seqs, gold = np.zeros((sequences, length), dtype=np.int64), np.zeros((sequences, length), dtype=np.int64)
    known = list(of_lang)
    for i in range(sequences):
        at = 0
        while at < length:
            d = rng.choice(of_lang[known[rng.integers(len(known))]])
            m = int(min(length - at, rng.integers(4, 40), first[d + 1] - first[d]))
            a = first[d] + rng.integers(0, first[d + 1] - first[d] - m + 1)
            seqs[i, at : at + m], gold[i, at : at + m] = word[a : a + m], lang[d]
            at += m
    w, a = np.zeros((SIZE, n), dtype=np.float32), np.zeros((n, n))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    root = np.sqrt(np.diff(begin))
    eye = np.eye(n)
    for step in range(1, steps + 1):
        rows = rng.integers(0, sequences, batch)
        x, y = seqs[rows], gold[rows]
        kinds, inv = np.unique(x, return_inverse=True)
        per = (begin[1:] - begin[:-1])[kinds]
        idx = flat[np.arange(per.sum()) + np.repeat(begin[kinds] - (np.cumsum(per) - per), per)]
        base = np.concatenate([[0], np.cumsum(per)[:-1]])
        p = (np.add.reduceat(w[idx], base, axis=0) / root[kinds][:, None])[inv.reshape(x.shape)]
        e = np.exp(p - p.max(axis=2, keepdims=True))
        move = np.exp(a - a.max())
        f, b = np.empty_like(e), np.ones_like(e)
        for t in range(length):
            s = e[:, 0] if t == 0 else (f[:, t - 1] @ move) * e[:, t]
            f[:, t] = s / s.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            s = (e[:, t + 1] * b[:, t + 1]) @ move.T
            b[:, t] = s / s.sum(axis=1, keepdims=True)
        m = f * b
        m /= m.sum(axis=2, keepdims=True)
        left, right = f[:, :-1].reshape(-1, n), (e[:, 1:] * b[:, 1:]).reshape(-1, n)
        pair = move * ((left / ((left @ move) * right).sum(axis=1, keepdims=True)).T @ right)  # summed over all places
        true_pair = np.bincount(y[:, :-1].ravel() * n + y[:, 1:].ravel(), minlength=n * n).reshape(n, n)
        ga = (pair - true_pair) / len(rows) + 1e-3 * a
        d = (m - eye[y]).reshape(-1, n)
        dk = np.stack([np.bincount(inv.ravel(), d[:, k], len(kinds)) for k in range(n)], axis=1) / root[kinds][:, None] / len(rows)
        spread = np.repeat(dk, per, axis=0)
        gw = np.stack([np.bincount(idx, spread[:, k], SIZE) for k in range(n)], axis=1).astype(np.float32) + np.float32(1e-5) * w
        for g, p_, mm, vv in ((gw, w, mw, vw), (ga, a, ma, va)):
            mm *= 0.9
            mm += 0.1 * g
            vv *= 0.99
            vv += 0.01 * g * g
            p_ -= 0.05 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)
    return Crf(langs, w.astype(np.float32), a - a.max())


def training_spans(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample: of each language (every value of lang) at most `rows` whole training documents (crc32(doc_id) mod 5 not 0), those of least hash; rows that repeat stand once. One pass for the counts and one for the texts. Null texts and languages are left out; an empty table gives none."""
    known = docs.where("lang is not null and text is not null").where(~held_out()).select("lang", "doc_id", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang")
    if not counts:
        return []
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 40, int(3 * (rows + 20) / r["n"] * (1 << 40)))) for r in counts], "lang string, share long")
    # First by a threshold that keeps about three times as many, so that little is sorted; copies of a text differ in doc_id.
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit(5))).join(F.broadcast(shares), "lang")
    few = hashed.where(F.pmod("h", F.lit(1 << 40)) < F.col("share")).dropDuplicates(["lang", "doc_id", "text"])
    turn = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "doc_id", "text")
    picked = few.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= rows)
    return [(r["lang"], r["text"]) for r in picked.select("lang", "text", "k").orderBy("lang", "k").collect()]


def languages(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; `und` with score 0 for null texts and texts without a letter (or without a learned language). A null doc_id isn't held out. Rows that repeat are predicted each; an empty table gives no rows; other columns aren't read."""
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for a, b, raw, offsets in chunks(batch.column(2)):
                n = model.expected(raw, offsets) if model.langs else np.zeros((b - a, 1))
                total = n.sum(axis=1)
                some = letters[a:b] & (total > 0)
                best = np.where(some, n.argmax(axis=1), len(model.langs))
                score = np.where(some, n.max(axis=1) / np.maximum(total, 1e-12), 0.0)
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
