"""Exact removal of repeated passages: every byte covered by a `least`-byte string that also starts elsewhere.

Suffix arrays of all texts would need many times their bytes, and most suffixes match nothing. So:

1. Anchors. Each text is winnowed: of every run of `least - K + 1` consecutive K-byte strings the one with the
   smallest hash is an anchor. Equal `least`-byte strings hold an anchor with equal hash, so a string without a
   repeated anchor repeats nowhere. The segment of an anchor is all of the text that such strings around it cover.
2. Anchors with a repeated hash meet by hash. Segments that are equal as a whole cover each other; they are counted,
   and one stands for all.
3. The different segments of a hash are gathered in blocks. A suffix array by two-stage sorting and the common
   prefixes of its neighbours tell which of their strings repeat at another place.
4. Hashes with more than BLOCK_SEGMENTS different segments go another exact way: all their strings meet by hash.
5. Covered bytes of each text are merged and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, forget, join_hot, small_batches
from graphloom.llm.suffixes import common_prefixes, suffix_array
from graphloom.llm.words import chunks, powers, splitmix

K = 128
BLOCK_BYTES = 1 << 20
ANCHOR_BYTES = 256 << 10  # of text winnowed at once: work arrays of 8 bytes a byte stay in cache
BLOCK_SEGMENTS = 8_000
_U = np.uint64
_RAW = splitmix(np.arange(256, dtype=np.uint64) + _U(4000))


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill) -> np.ndarray:
    """f over every w consecutive values: len(x) - w + 1 results."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_RAW[raw] * power[: len(raw)], out=sums[1:])
    return sums, inverse


_P = (1 << 31) - 1
_OTHER = (splitmix(np.arange(256, dtype=np.uint64) + _U(9000)) % _U(_P)).astype(np.uint64)
_other_powers: list[np.ndarray] = []


def prime_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As prefix_sums, but modulo the prime 2 ** 31 - 1 and over other values: strings that a polynomial modulo 2 ** 64 can't tell apart differ here."""
    n = len(raw) + 1
    if not _other_powers or len(_other_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (48_271, pow(48_271, -1, _P)):
            p, have = np.ones(size, dtype=np.uint64), 1
            while have < size:  # doubling: the second half is the first one times a power
                p[have : 2 * have] = p[:have] * _U(pow(base, have, _P)) % _U(_P)
                have *= 2
            out.append(p)
        _other_powers[:] = out
    power, inverse = _other_powers[0][:n], _other_powers[1][:n]
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(_OTHER[raw] * power[: len(raw)] % _U(_P), out=sums[1:])
    return sums, inverse


def prime_hash(sums: np.ndarray, inverse: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (sums[hi] - sums[lo]) % _U(_P) * inverse[lo] % _U(_P)


def anchors(raw: np.ndarray, offsets: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, hash, segment start and end (in the text), and segment hash of each anchor. Texts under `least` bytes have none."""
    w = least - k + 1
    n = len(raw) - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n < w:
        return (none,) * 6
    sums, inverse = prefix_sums(raw)
    h = splitmix((sums[k:] - sums[:-k]) * inverse[:n])
    lowest = _sliding(h, w, np.minimum, _U(0xFFFFFFFFFFFFFFFF))
    around = np.zeros(n + w - 1, dtype=np.uint64)
    around[w - 1 : w - 1 + len(lowest)] = lowest
    at = np.flatnonzero(_sliding(around, w, np.maximum, _U(0)) == h)
    text = np.searchsorted(offsets, at, side="right") - 1
    whole = (at + k <= offsets[text + 1]) & (offsets[text + 1] - offsets[text] >= least)
    at, text = at[whole], text[whole]
    if len(at):
        # Of a run of equal hashes (periodic text) the first and last in each half window do.
        value = h[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (np.diff(at) >= w) | (text[1:] != text[:-1])
        run = np.cumsum(new) - 1
        bin_ = (at - at[new][run]) // max(1, w // 2)
        first = new.copy()
        first[1:] |= bin_[1:] != bin_[:-1]
        keep = first | np.append(first[1:], True)
        at, text = at[keep], text[keep]
    lo = np.maximum(offsets[text], at + k - least)
    hi = np.minimum(offsets[text + 1], at + least)
    plain = splitmix((sums[hi] - sums[lo]) * inverse[lo]) ^ splitmix(prime_hash(*prime_sums(raw), lo, hi)) if len(at) else _RAW[:0]
    s = splitmix(plain + (hi - lo).astype(np.uint64) * _U(1 << 20) + (at - lo).astype(np.uint64))
    base = offsets[text]
    return text, at - base, h[at], lo - base, hi - base, s


def covered(block: list[bytes], places: list[tuple], least: int) -> list[list[tuple[int, int]]]:
    """Of each segment, the merged ranges that its repeated `least`-byte strings cover. places: (text, start of the segment) of each; strings at one place are one."""
    text = b"\xff".join(block) + b"\xff"  # no byte of UTF-8
    size = np.array([len(x) for x in block])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    starts = np.zeros(len(text) + 1, dtype=np.int64)  # of strings that lie within a segment
    np.add.at(starts, begin, 1)
    np.add.at(starts, begin + np.maximum(size - least + 1, 0), -1)
    suffixes = suffix_array(text, least, np.cumsum(starts[:-1]) > 0)
    shared = common_prefixes(text, suffixes, least) >= least
    segment = np.searchsorted(begin, suffixes, side="right") - 1
    inside = suffixes - begin[segment]
    fits = inside + least <= size[segment]
    # Neighbours with `least` bytes in common are one class; strings over a segment's end don't count.
    of_class = np.cumsum(~shared)
    pick = np.flatnonzero(fits)
    ids: dict = {}
    text_of = np.array([ids.setdefault(t, len(ids)) for t, _ in places])
    start_of = np.array([s for _, s in places])
    c, seg, inn = of_class[pick], segment[pick], inside[pick]
    spot = text_of[seg] * np.int64(1 << 40) + start_of[seg] + inn
    order = np.lexsort((spot, c))
    c, seg, inn, spot = c[order], seg[order], inn[order], spot[order]
    fresh = np.ones(len(c), dtype=bool)
    fresh[1:] = (c[1:] != c[:-1]) | (spot[1:] != spot[:-1])
    if len(c):
        _, back = np.unique(c, return_inverse=True)
        repeated = np.bincount(back, fresh)[back] >= 2
        seg, inn = seg[repeated], inn[repeated]
    order = np.lexsort((inn, seg))
    seg, inn = seg[order], inn[order]
    out: list[list[tuple[int, int]]] = [[] for _ in block]
    if len(seg):
        new = np.ones(len(seg), dtype=bool)
        new[1:] = (seg[1:] != seg[:-1]) | (np.diff(inn) > least)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:] - 1, len(seg) - 1)
        for a, b in zip(firsts, lasts, strict=True):
            out[seg[a]].append((int(inn[a]), int(inn[b]) + least))
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


KEY = ["kid", "t1", "t2"]
_KEYED = "kid long, t1 long, t2 long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("kid"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def repeated_passages(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text", output: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `output` also kept, the remaining bytes.

    A byte of a text's UTF-8 goes if a `least`-byte string covers it that starts anywhere else in docs, same text
    included. Null text is empty; texts under `least` bytes lose nothing; rows that repeat are copies of one another;
    an empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    k = min(K, max(1, least // 3))
    keyed = _keyed(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column(3), ANCHOR_BYTES):
                text, at, h, lo, hi, s = anchors(raw, offsets, least, k)
                rows = batch.slice(a, b - a).take(pa.array(text))
                yield pa.record_batch([*rows.columns[:3], pa.array(h.view(np.int64)), pa.array(at), pa.array(s.view(np.int64))], names=[*KEY, "h", "at", "s"])

    found = cut(keyed.select(*KEY, "text").mapInArrow(find, f"{_KEYED}, h long, at long, s long"), "anchors")
    total = found.count()
    twice = found.groupBy("h").agg(F.count("*").alias("of_h")).where("of_h > 1")
    again = cut(join_hot(found, twice, ["h"], "of_h", total), "anchors2")
    forget(found)
    equal = again.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("one"))
    kinds = equal.groupBy("h").agg(F.count("*").alias("kinds"))
    told = join_hot(again.drop("of_h"), equal.join(kinds, "h"), ["h", "s"], "n", total)
    use = (F.col("kinds") > 1) & (F.struct(*KEY, "at") == F.col("one"))
    spot = F.struct("at", "h", (F.col("n") > 1).alias("whole"), use.alias("use"), (F.col("kinds") > BLOCK_SEGMENTS).alias("large"))
    listed = told.groupBy(*KEY).agg(F.collect_set(spot).alias("spots"))
    joined = keyed.join(listed, KEY, "left")
    some = F.col("spots").isNotNull()
    parted = cut(joined.select("doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.when(~some, F.sha2(F.col("text"), 256)).alias("sha"), F.when(some | F.lit(output), F.col("text")).alias("text"), "spots"), "parted")
    touched = parted.where("spots is not null")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["text"].encode()
                out = [(x["h"], x["large"], max(0, x["at"] + k - least), raw[max(0, x["at"] + k - least) : x["at"] + least]) for x in row["spots"] if x["use"]]
                out = [x for x in out if len(x[3]) >= least]
                if out:
                    h, large, lo, seg = zip(*out, strict=True)
                    yield pa.record_batch([pa.array([row[c]] * len(out), pa.int64()) for c in KEY] + [pa.array(h, pa.int64()), pa.array(large), pa.array(lo, pa.int64()), pa.array(seg, pa.binary())], names=[*KEY, "h", "large", "lo", "seg"])

    once = touched.where(F.exists("spots", lambda x: x["use"])).select(*KEY, "text", "spots").dropDuplicates(KEY)
    pieces = cut(once.mapInArrow(segments, f"{_KEYED}, h long, large boolean, lo long, seg binary"), "segments")

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, size, last = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*key, lo + a, lo + b) for (key, lo), ranges in zip(places, covered(block, places, least), strict=True) for a, b in ranges]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[*KEY, "lo", "hi"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for key, h, lo, seg in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if h != last and size >= BLOCK_BYTES:
                    yield from flush()
                    block, places, size = [], [], 0
                last, size = h, size + len(seg)
                block.append(seg)
                places.append((key, lo))
        if block:
            yield from flush()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = np.frombuffer(row["seg"], dtype=np.uint8)
                sums, inverse = prefix_sums(seg)
                n = len(seg) - least + 1
                plain = splitmix((sums[least:] - sums[:-least]) * inverse[:n])
                other = prime_hash(*prime_sums(seg), np.arange(n), np.arange(n) + least)
                yield pa.record_batch([pa.array([row[c]] * n, pa.int64()) for c in KEY] + [pa.array(row["lo"] + np.arange(n)), pa.array(plain.view(np.int64)), pa.array(other.view(np.int64))], names=[*KEY, "lo", "a", "b"])

    normal = pieces.where("not large").select(*KEY, "h", "lo", "seg").repartition("h").sortWithinPartitions("h")
    sorted_ = normal.mapInArrow(sort_blocks, f"{_KEYED}, lo long, hi long")
    each = pieces.where("large").mapInArrow(strings, f"{_KEYED}, lo long, a long, b long").distinct()
    both = each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    hot = each.join(both, ["a", "b"]).select(*KEY, "lo", (F.col("lo") + least).alias("hi"))
    marks = sorted_.unionByName(hot).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    ready = touched.join(marks, KEY, "left").select("doc_id", "n_bytes", "text", "spots", "marks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw = row["text"].encode()
                ranges = [(max(0, x["at"] + k - least), min(len(raw), x["at"] + least)) for x in row["spots"] if x["whole"]]
                ranges = _merged([r for r in ranges if r[1] - r[0] >= least] + [(m["lo"], m["hi"]) for m in row["marks"] or ()])
                kept, at = [], 0
                for a, b in ranges:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                rows.append((row["doc_id"], len(raw), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(rest).hexdigest(), rest if output else None))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cleaned = ready.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    clean = parted.where("spots is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    out = clean.unionByName(cleaned)
    return out if output else out.drop("kept")


#: The same rows from all strings of 400 bytes (for tables without repeated identifiers).
SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
p AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, n_bytes - 399)) AS i FROM b)),
t AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS first FROM t),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(first::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM r UNION ALL SELECT doc_id, coalesce(max(z), 0), any_value(n_bytes) FROM b LEFT JOIN r USING (doc_id) GROUP BY doc_id),
j AS (SELECT doc_id, string_agg(hex(b[k.a + 1:k.z]), '' ORDER BY k.a) AS x FROM k JOIN b USING (doc_id) WHERE k.z > k.a GROUP BY doc_id),
m AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256 FROM b LEFT JOIN m USING (doc_id) LEFT JOIN j USING (doc_id)
"""
