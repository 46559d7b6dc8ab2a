"""Words and shingles of whole texts, for many texts at once in numpy.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A document's shingles are its runs of five words; with fewer
words, all of them as one. Both are 64-bit hashes; a word's mixes its bytes eight at a time, each step a bijection of
what was before, so no two words meet by their structure (as they can in a polynomial modulo 2 ** 64). Words are found
by windows: a long text needs few bytes beside its own and 16 for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
CHUNK_BYTES = 1 << 20
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + _U(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = splitmix(np.arange(256, dtype=np.uint64))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
LONG = 1_024  # bytes of a word that is hashed by rounds
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C55
_PLACE = splitmix(np.arange(1000, 1000 + WIDTH, dtype=np.uint64)) | _U(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        out = []
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of consecutive texts of about `most` bytes together; null is as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def segments(raw: np.ndarray, offsets: np.ndarray, each: int, together: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text of each) of stretches of texts, `together` bytes or so at a time. A text over `each` bytes is cut after white space (a word over `each` bytes anywhere)."""
    ends, owner = [], []
    for i in np.flatnonzero(np.diff(offsets) > each).tolist() if len(offsets) > 1 else ():
        a, b = int(offsets[i]), int(offsets[i + 1])
        while b - a > each:
            gap = np.flatnonzero(raw[a : a + each] <= 32)
            a += int(gap[-1]) + 1 if len(gap) else each
            ends.append(a)
            owner.append(i)
    n = len(offsets) - 1
    bound = np.concatenate([offsets[1:], np.array(ends, dtype=np.int64)])
    of = np.concatenate([np.arange(n), np.array(owner, dtype=np.int64)]).astype(np.int64)
    order = np.lexsort((bound, of))
    bound, of = np.concatenate([offsets[:1], bound[order]]), of[order]
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + together, side="right")) - 1)
        yield raw[bound[at] : bound[to]], bound[at : to + 1] - bound[at], of[at:to]
        at = to


def count_bytes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each text a table of 256 flags marks."""
    out, total = np.zeros(len(offsets), dtype=np.int64), 0
    for a in range(0, len(raw), CHUNK_BYTES):
        part = np.concatenate([[0], np.cumsum(table[raw[a : a + CHUNK_BYTES]], dtype=np.int64)])
        mine = slice(int(np.searchsorted(offsets, a, side="right")), int(np.searchsorted(offsets, a + len(part) - 1, side="right")))
        out[mine] = total + part[offsets[mine] - a]
        total += int(part[-1])
    return np.diff(out)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses an offset."""
    filled = ~_SPACE[raw]
    n = len(raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, filled[:-1]
    start = filled & (~before | edge[:-1])
    after = np.empty(n, dtype=bool)
    after[-1:], after[:-1] = False, filled[1:]
    end = filled & (~after | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... of stretches, one after another."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z as a-z. Rounds of eight bytes; words over LONG bytes go by a digest of their own."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([_SMALL[raw], np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    out = splitmix(left.astype(np.uint64))
    for i in np.flatnonzero(left > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    some = np.flatnonzero(left <= LONG)
    left = left[some]
    for k in range(0, LONG, 8):
        out[some] = splitmix(out[some] ^ (eights[starts[some] + k] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        some, left = some[more], left[more] - 8
        if not len(some):
            break
    return out


def words_of_texts(raw: np.ndarray, offsets: np.ndarray, window: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the first of each text (one more at the end); work arrays are of windows that end after white space."""
    n = len(raw)
    hashes, starts_ = [], []
    at, width = 0, window
    while at < n:
        to = min(n, at + width)
        if to < n:
            gap = np.flatnonzero(_SPACE[raw[at:to]])
            if not len(gap):
                edge = offsets[np.searchsorted(offsets, to, side="right") - 1]
                if edge <= at:  # a word longer than the window
                    width *= 2
                    continue
                to = int(edge)
            else:
                to = at + int(gap[-1]) + 1
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        starts, ends = word_spans(raw[at:to], inner)
        hashes.append(word_hashes(raw[at:to], starts, ends))
        starts_.append(starts + at)
        at, width = to, window
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_), offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, in order and with repeats, and where each text's begin (one more at the end)."""
    words, first = words_of_texts(raw, offsets)
    count = np.diff(first)
    n = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    bound = np.concatenate([[0], np.cumsum(n)])
    padded = np.concatenate([words, np.zeros(WIDTH, dtype=np.uint64)])
    sums = padded[: len(words)] * _PLACE[0]
    for j in range(1, WIDTH):
        sums += padded[j : len(words) + j] * _PLACE[j]
    out = sums[ragged(first[:-1], n)]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    for i in short:
        own = words[first[i] : first[i + 1]]
        out[bound[i]] = np.sum(own * _PLACE[: len(own)], dtype=np.uint64)
    return splitmix(out), bound


def unique_sets(hashes: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def min_hashes(hashes: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """k 32-bit minimum hashes of each text (all ones for texts without shingles)."""
    out = np.full((len(bound) - 1, k), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(bound))
    if not len(some):
        return out
    x = (hashes ^ (hashes >> _U(32))).astype(np.uint32)
    seeds = (splitmix(np.arange(k, dtype=np.uint64) + _U(77)) >> _U(16)).astype(np.uint32) | np.uint32(1)
    at, buf, high = bound[:-1][some], np.empty_like(x), np.empty_like(x)
    for j in range(k):
        np.multiply(x, seeds[j], out=buf)
        np.right_shift(buf, np.uint32(15), out=high)
        np.bitwise_xor(buf, high, out=buf)
        np.multiply(buf, np.uint32(0x2C1B3C6D), out=buf)
        out[some, j] = np.minimum.reduceat(buf, at)
    return out
