r"""Token ids in sorted-string-table shards.

A shard is one file:

    data block, "\n", ..., index, "\n", Bloom filter, "\n", footer, "\n"

* Data block: documents in ascending key order. Each entry is `shared` (bytes of key in common with the
  previous key of the block), `unshared`, `n_tokens` as varints, the unshared key bytes, then the ids as
  little-endian unsigned integers of the footer's width. A CRC-32 of all that closes the block.
* Index: for each block its first key, its offset, length and number of documents (sparse: one per block).
* Bloom filter: bits for every key, double hashing.
* Footer: fixed length, with magic, positions of index and filter, counts and shard number.

A key is b"\0" for a null identifier, else b"\1" and the identifier as a big-endian 64-bit integer with its sign
bit flipped, so that byte order is numeric order and nulls come first. Shards split the range of
(identifier, hash of text); shard numbers ascend with it, so concatenated shards are in order. Files are
written by Spark's text writer from rows of bytes (the "\n" are its separators): commits are atomic, retried
tasks leave nothing, and any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import fresh_path, sized_partitions, small_batches
from graphloom.llm.pieces import encoder

MAGIC = b"GLSST001"
FOOTER = struct.Struct("<8sIIQQQQQQI")  # magic, shard, id width, docs, tokens, index at/len, bloom at/len, hashes
INDEX = struct.Struct("<QII")
BLOCK_BYTES = 64 << 10
SHARD_TEXT_BYTES = 16 << 20
BLOOM_BITS = 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_at(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class ShardWriter:
    """Turns documents in key order into the byte rows of one shard; holds a block at a time, and a few bytes a document."""

    def __init__(self, shard: int, width: int):
        self.shard, self.width, self.at, self.docs, self.tokens = shard, width, 0, 0, 0
        self.block: list[bytes] = []
        self.size, self.in_block, self.first, self.last = 0, 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def _out(self, raw: bytes) -> bytes:
        self.at += len(raw) + 1
        return raw

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        same = len(os.path.commonprefix([key, self.last]))
        n = len(ids) // self.width
        head = _varint(same) + _varint(len(key) - same) + _varint(n) + key[same:]
        self.block += [head, ids]
        self.size += len(head) + len(ids)
        self.in_block, self.last, self.docs, self.tokens = self.in_block + 1, key, self.docs + 1, self.tokens + n
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            yield self._flush()

    def _flush(self) -> bytes:
        raw = b"".join(self.block)
        raw += struct.pack("<I", zlib.crc32(raw))
        self.index.append(_varint(len(self.first)) + self.first + INDEX.pack(self.at, len(raw), self.in_block))
        self.block, self.size, self.in_block = [], 0, 0
        return self._out(raw)

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._flush()
        index, index_at = b"".join(self.index), self.at
        yield self._out(index)
        bits, hashes = max(64, -(-BLOOM_BITS * len(self.keys) // 8) * 8), 7
        bloom, bloom_at = np.zeros(bits // 8, dtype=np.uint8), self.at
        for key in self.keys:
            for b in _bloom_at(key, bits, hashes):
                bloom[b >> 3] |= 1 << (b & 7)
        yield self._out(bloom.tobytes())
        yield self._out(FOOTER.pack(MAGIC, self.shard, self.width, self.docs, self.tokens, index_at, len(index), bloom_at, len(bloom), hashes))


class ShardReader:
    """Reads a shard through read_at(offset, length); a lookup reads filter, index and one block or a few."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        magic, self.shard, self.width, self.docs, self.tokens, at, n, bloom_at, bloom_n, self.hashes = FOOTER.unpack(read_at(size - 1 - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom_at, self.bloom_n, self.dtype = bloom_at, bloom_n, np.dtype(f"<u{self.width}")
        raw, at, self.index = read_at(at, n), 0, []
        while at < len(raw):
            k, at = _read_varint(raw, at)
            key, at = raw[at : at + k], at + k
            self.index.append((key, *INDEX.unpack_from(raw, at)))
            at += INDEX.size

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, docs = self.index[k]
        raw = self.read_at(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        pos, key = 0, b""
        for _ in range(docs):
            same, pos = _read_varint(raw, pos)
            more, pos = _read_varint(raw, pos)
            tokens, pos = _read_varint(raw, pos)
            key, pos = key[:same] + raw[pos : pos + more], pos + more
            yield key, np.frombuffer(raw, dtype=self.dtype, count=tokens, offset=pos)
            pos += tokens * self.width

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with that identifier: filter, binary search of the index, then its blocks."""
        from bisect import bisect_left

        key, bits = key_of(doc_id), self.bloom_n * 8
        bloom = self.read_at(self.bloom_at, self.bloom_n)
        if not all(bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_at(key, bits, self.hashes)):
            return []
        k, found = max(0, bisect_left(self.index, (key,)) - 1), []
        while k < len(self.index) and self.index[k][0] <= key:
            found += [ids for x, ids in self.block(k) if x == key]
            k += 1
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write every document (null text: empty; rows with the same identifier are all kept).

    The only shuffle deals texts by range of (identifier, hash of text), so a frequent identifier is split too.
    Other columns aren't read. An empty table leaves no shard.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = sized_partitions(spark, total, SHARD_TEXT_BYTES, 1 << 20)
    keyed = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shard = None
        for batch in batches:
            shard = shard or ShardWriter(TaskContext.get().partitionId(), enc.dtype.itemsize)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                for raw in shard.add(doc_id, ids.tobytes() + end):
                    yield pa.record_batch({"value": pa.array([raw], pa.binary())})
        for raw in shard.finish() if shard and shard.docs else ():
            yield pa.record_batch({"value": pa.array([raw], pa.binary())})

    keyed.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: shard, n-th in shard, doc_id, start within the shard, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0):
                raw = item.as_py()
                if not raw:
                    continue
                shard = ShardReader(lambda at, n, raw=raw: raw[at : at + n], len(raw))
                rows: tuple[list, ...] = ([], [], [], [], [])
                start = 0
                for k, (doc_id, ids) in enumerate(shard.documents()):
                    for column, x in zip(rows, (k, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(x)
                    start += len(ids)
                yield pa.record_batch([pa.array([shard.shard] * len(rows[0]), pa.int64()), *(pa.array(x, pa.int64()) for x in rows)], names=["shard", "k", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(read, "shard long, k long, doc_id long, at long, n_tokens long, ids_crc32 long")


def shard_directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: shard, file, first and last key (bytes, in key order), docs, tokens. A lookup opens those shards only whose range holds its key."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = item.as_py()
                shard = ShardReader(lambda at, n, raw=raw: raw[at : at + n], len(raw))
                last = b""
                for last, _ in shard.block(len(shard.index) - 1):
                    pass
                yield pa.record_batch([pa.array([x], t) for x, t in ((shard.shard, pa.int64()), (file, pa.string()), (shard.index[0][0], pa.binary()), (last, pa.binary()), (shard.docs, pa.int64()), (shard.tokens, pa.int64()))], names=["shard", "file", "first", "last", "docs", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(look, "shard long, file string, first binary, last binary, docs long, tokens long")


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int | None], directory: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of every stored document with one of some identifiers (a list in memory): a row each. directory: shard_directory(), kept as a table by those who look up often."""
    keys = sorted({key_of(x) for x in doc_ids})
    directory = shard_directory(spark, path) if directory is None else directory
    held = reduce(lambda a, k: a | ((F.col("first") <= F.lit(k)) & (F.col("last") >= F.lit(k))), keys, F.lit(False))
    files = [r["file"] for r in directory.where(held).select("file").collect()]  # as many as the identifiers lie in

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0):
                raw = item.as_py()
                shard = ShardReader(lambda at, n, raw=raw: raw[at : at + n], len(raw))
                for key in keys:
                    for ids in shard.get(id_of(key)):
                        yield pa.record_batch([pa.array([id_of(key)], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(find, "doc_id long, ids array<long>")


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write shards (to a fresh shared folder unless path is given) and read them back.

    Returns doc_id, start (ids of all documents before it, in ascending doc_id order; rows with the same doc_id
    follow by a hash of their text), n_tokens (with the end id), ids_crc32. Null text is empty; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    rows = read_shards(spark, path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    before = totals.select("shard", (F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    return rows.join(before, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
