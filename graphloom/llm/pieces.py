"""Token ids of many texts by a byte-level BPE of the tokenizers library, whose pieces are encoded once and remembered.

The pre-tokenizer of such a tokenizer cuts a text into runs of letters, of digits, of other signs (each with the space
before it) and of white space. A piece is a stretch between places where it must cut, whatever surrounds them:

* before a space that follows no white space,
* between an ASCII letter, an ASCII digit and an ASCII sign (but the apostrophe, which may begin a contraction),
* before a line feed that follows an ASCII letter or digit, and after one that stands alone between ASCII characters.

The ids of a text are those of its pieces in turn. Pieces of up to 64 bytes are kept in a hash table of 128-bit keys in
numpy arrays; new ones are encoded in runs. Texts that hold an added token (such as an end mark) go through the library
whole. Work arrays are of windows, so a long text needs no more than its bytes and its ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.words import splitmix

WINDOW = 512 << 10  # bytes worked on at once
LONGEST = 64  # bytes of a remembered piece
SLOTS = 1 << 21
MOST_PIECES = SLOTS * 5 // 8  # then the table starts anew
RUN = 1_000
_U = np.uint64

_OTHER, _LETTER, _DIGIT, _SIGN, _FEED = range(5)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(33, 127)]] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(48, 58)]] = _DIGIT
_CLASS[ord("'")] = _OTHER
_CLASS[10] = _FEED
#: By class of the byte before and of the byte: whether a piece begins.
_CUT = np.zeros((5, 5), dtype=bool)
for _a in (_LETTER, _DIGIT, _SIGN):
    for _b in (_LETTER, _DIGIT, _SIGN):
        _CUT[_a, _b] = _a != _b
_CUT[_LETTER, _FEED] = _CUT[_DIGIT, _FEED] = True
_CUT = _CUT.ravel()
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_loaded: dict[str, "PieceEncoder"] = {}


#: The characters of three bytes that are white space, or have been in some version of Unicode.
_WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def ends_space(raw: np.ndarray) -> np.ndarray:
    """Whether white space of any kind, or a control character that may count as such, ends at each byte."""
    out = (raw <= 32) | (raw == 127)
    out[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
    at = np.flatnonzero((raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    if len(at):
        out[at[np.isin(raw[at].astype(np.int64) << 16 | raw[at + 1].astype(np.int64) << 8 | raw[at + 2], _WIDE)] + 2] = True
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... of stretches, one after another."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        top = max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.added = [t["content"] for t in kind.get("added_tokens") or ()]
        before, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
        self.cuts = bool(byte_level and not kind.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and "Ċ" in vocab)
        if self.cuts:
            self.tok.model._resize_cache(0)  # ours holds what repeats
            self.feed = vocab["Ċ"]
            self.space = np.zeros(top + 1, dtype=bool)
            self.space[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
            self._clear()

    def _clear(self) -> None:
        self.number = np.zeros(SLOTS, dtype=np.int32)  # of the piece, from 1
        self.key_a, self.key_b = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.count = 0
        self.at, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)  # number 0: no ids
        self.pool, self.filled = np.zeros(1 << 18, dtype=self.dtype), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    # Finding pieces

    @staticmethod
    def _starts(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin (each edge is one), and ends_space."""
        n = len(raw)
        blank, cls = ends_space(raw), _CLASS[raw]
        begin = np.zeros(n + 1, dtype=bool)
        begin[1:n] = _CUT[cls[:-1] * np.uint8(5) + cls[1:]]
        begin[1:n] |= (raw[1:] == 32) & ~blank[:-1]
        if n > 2:
            begin[2:n] |= (cls[1:-1] == _FEED) & (cls[:-2] != _OTHER) & (cls[:-2] != _FEED) & (cls[2:] != _OTHER) & (cls[2:] != _FEED)
            # A feed that begins a text isn't one between characters of it.
            inner = edges[(edges > 0) & (edges + 1 < n)]
            first = inner[(cls[inner] == _FEED)] + 1
            begin[first] = False
        begin[edges] = True
        begin[n] = False
        return np.flatnonzero(begin), blank

    @staticmethod
    def _keys(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit keys of pieces of up to LONGEST bytes."""
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        words = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        a, b = splitmix(length.astype(np.uint64)), splitmix(length.astype(np.uint64) + _U(1 << 32))
        some, left = np.arange(len(start)), length
        for k in range(0, LONGEST, 8):
            w = words[start[some] + k] & _MASK[np.minimum(left, 8)]
            a[some] = splitmix(a[some] ^ w)
            b[some] = splitmix((b[some] ^ w) * _U(0xD6E8FEB86659FD93))
            more = left > 8
            if not more.any():
                break
            some, left = some[more], left[more] - 8
        return a, b

    # The table

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, else 0."""
        slot = (a >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.number[slot]
        todo = np.flatnonzero((out > 0) & ((self.key_a[slot] != a) | (self.key_b[slot] != b)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (SLOTS - 1)
            got = self.number[slot]
            out[todo] = got
            go = (got > 0) & ((self.key_a[slot] != a[todo]) | (self.key_b[slot] != b[todo]))
            todo, slot = todo[go], slot[go]
        return out

    def _insert(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        slot = (a >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            free = self.number[slot[todo]] == 0
            some = todo[free]
            self.number[slot[some]] = number[some]  # of pieces that want one slot the last gets it
            won = some[self.number[slot[some]] == number[some]]
            self.key_a[slot[won]], self.key_b[slot[won]] = a[won], b[won]
            done = np.zeros(len(a), dtype=bool)
            done[won] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _store(self, parts: list[np.ndarray]) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        size = np.array([len(p) for p in parts], dtype=np.int64)
        total, n = int(size.sum()), len(parts)
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=self.dtype)])
        while self.count + n + 1 > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        if total:
            self.pool[self.filled : self.filled + total] = np.concatenate(parts)
        number = np.arange(self.count + 1, self.count + n + 1)
        self.at[number], self.length[number] = self.filled + np.cumsum(size) - size, size
        self.filled, self.count = self.filled + total, self.count + n
        return number.astype(np.int32)

    # Encoding pieces

    def _learn(self, raw: np.ndarray, blank: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Ids of each of these pieces."""
        bound = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        body = np.ascontiguousarray(raw[ragged(start, length)])
        texts = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bound), pa.py_buffer(body)]).to_pylist()
        blanks = np.concatenate([[0], np.cumsum(blank)])
        spaced = raw[start] == 32
        plain = blanks[start + length] - blanks[start] == spaced  # no white space but a space at the start
        plain &= length > spaced
        out: list[np.ndarray | None] = [None] * len(texts)
        for lead in (True, False):
            mine = np.flatnonzero(plain & (spaced == lead)).tolist()
            for k in range(0, len(mine), RUN):
                some = mine[k : k + RUN]
                joined = "".join(texts[i] for i in some) if lead else "".join("\n" + texts[i] for i in some)
                ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
                heads = np.flatnonzero(self.space[ids] if lead else ids == self.feed)
                if len(heads) == len(some):
                    first, ends = heads + (not lead), np.append(heads[1:], len(ids))
                    for i, x, y in zip(some, first.tolist(), ends.tolist(), strict=True):
                        out[i] = ids[x:y]
        return [self._ids(t) if p is None else p for p, t in zip(out, texts, strict=True)]

    def _window(self, raw: np.ndarray, blank: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in turn, and how many each has."""
        if self.count > MOST_PIECES:
            self._clear()
        number = np.zeros(len(start), dtype=np.int32)
        short = np.flatnonzero(length <= LONGEST)
        a, b = self._keys(raw, start[short], length[short])
        number[short] = self._find(a, b)
        new = np.flatnonzero(number[short] == 0)
        if len(new):
            order = np.lexsort((b[new], a[new]))
            new = new[order]
            first = np.ones(len(new), dtype=bool)
            first[1:] = (a[new[1:]] != a[new[:-1]]) | (b[new[1:]] != b[new[:-1]])
            one = new[first]
            got = self._store(self._learn(raw, blank, start[short[one]], length[short[one]]))
            if self.count <= SLOTS * 7 // 8:
                self._insert(a[one], b[one], got)
            number[short[new]] = got[np.cumsum(first) - 1]
        count, at = self.length[number], self.at[number]
        long = np.flatnonzero(length > LONGEST)
        if not len(long):
            return self.pool[ragged(at, count)], count
        parts = [self._ids(raw[start[i] : start[i] + length[i]].tobytes().decode()) for i in long.tolist()]
        count[long] = [len(p) for p in parts]
        count, pool = count.astype(np.int64), self.pool[: self.filled]
        at[long] = len(pool) + np.cumsum(count[long]) - count[long]
        return np.concatenate([pool, *parts])[ragged(at, count)], count

    def _stretch(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text of a buffer, by windows that end where a piece does."""
        at, width, doc, n = 0, WINDOW, 0, len(raw)
        held: list[np.ndarray] = []
        while at < n:
            to = min(n, at + width)
            edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
            start, blank = self._starts(raw[at:to], np.unique(np.append(edges, 0)))
            if to < n:
                if len(start) < 2:
                    width *= 2
                    continue
                to = at + int(start[-1])  # the last piece may go on
                start = start[:-1]
            length = np.diff(np.append(start, to - at))
            ids, count = self._window(raw[at:to], blank, start, length)
            bound = np.concatenate([[0], np.cumsum(count)])
            inside = offsets[doc + 1 : np.searchsorted(offsets, to, side="right")]  # ends of the texts that end here
            cuts = bound[np.searchsorted(start, inside - at)]
            for part in np.split(ids, cuts)[:-1] if len(cuts) else ():
                yield np.concatenate([*held, part]) if held else part
                held = []
                doc += 1
            rest = ids[cuts[-1] if len(cuts) else 0 :]
            if len(rest):
                held.append(rest)
            at, width = to, WINDOW
        while doc < len(offsets) - 1:  # empty texts at the end
            yield np.zeros(0, dtype=self.dtype)
            doc += 1

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        whole = np.full(len(texts), not self.cuts)
        for mark in self.added if self.cuts else ():
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        turn = np.flatnonzero(whole[1:] != whole[:-1]) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(texts)], strict=True):
            if whole[a]:
                for t in texts.slice(a, b - a):
                    yield self._ids(t.as_py())
                continue
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset + a : texts.offset + b + 1]
            raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
            yield from self._stretch(raw, offsets - offsets[0])


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
