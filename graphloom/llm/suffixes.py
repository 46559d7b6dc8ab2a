"""Suffix arrays by two-stage sorting, and the common prefixes of neighbours.

Suffixes that are smaller than their successor are sorted directly; a scan of the buckets of first bytes, in
order, induces all others from them, since suffix i + 1 < suffix i is met before the place of suffix i.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Of each suffix, whether it is smaller than its successor; the last one's is empty, so it is not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differs] < text[differs + 1]
    at = np.searchsorted(differs, np.arange(n))
    return np.append(rises, False)[np.minimum(at, len(differs))]


def suffix_array(text: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes, or the wanted ones (flags) and those that induce them, in an order that is right for their first `depth` bytes at least."""
    t = np.frombuffer(text, dtype=np.uint8)
    if not len(t):
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(t)
    if wanted is None:
        wanted = np.ones(len(t), dtype=bool)
    else:  # a larger suffix needs its successors up to one that is sorted directly
        at = np.arange(len(t))
        run = np.maximum.accumulate(np.where(small, at, -1))  # the last directly sorted place up to here
        last = np.maximum.accumulate(np.where(wanted, at, -1))
        before = np.concatenate([[-1], run[:-1]])
        wanted = wanted | ((last >= 0) & (before < last))
    direct = np.flatnonzero(small & wanted)
    direct = direct[np.argsort(t[direct], kind="stable")]
    bound = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deals the larger predecessors of sorted suffixes to their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[~small[before] & wanted[before]]
        first = t[before]
        here = before[first == c]
        rest, first = before[first != c], first[first != c]
        if len(rest):
            order = np.argsort(first, kind="stable")
            rest, first = rest[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(rest, cuts):
                pending[t[part[0]]].append(part)
        return here

    induce(np.array([len(t)]), -1)
    for c in range(256):
        if pending[c]:
            found = np.concatenate(pending[c])
            while len(found):
                out.append(found)
                found = induce(found, c)
        own = direct[bound[c] : bound[c + 1]]
        if len(own):
            own = np.array(sorted(own.tolist(), key=lambda i: text[i : i + depth]), dtype=np.int64)
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(text: bytes, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, `most` at most; 0 for the first."""
    padded = np.frombuffer(text + bytes(most + 8), dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:1].view(), shape=(len(text) + most, 8), strides=(1, 1)) if len(text) else None
    out = np.zeros(len(suffixes), dtype=np.int64)
    if len(suffixes) < 2:
        return out
    eights = np.ascontiguousarray(words).view("<u8").ravel()
    left = len(text)
    alive = np.arange(1, len(suffixes))
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    for _ in range(0, most, 8):
        same = eights[a] == eights[b]
        stop = ~same
        if stop.any():
            x = eights[a[stop]] ^ eights[b[stop]]
            low = x & (~x + np.uint64(1))
            out[alive[stop]] += np.floor(np.log2(low.astype(np.float64))).astype(np.int64) >> 3
        alive, a, b = alive[same], a[same] + 8, b[same] + 8
        out[alive] += 8
        if not len(alive):
            break
    end = left - np.maximum(suffixes[1:], suffixes[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], end), most)
    return out
