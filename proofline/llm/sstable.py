"""Operator 9: token documents in sorted-string-table shards.

A shard holds documents in key order, in blocks whose keys share prefixes, a sparse index with each block's last key,
a Bloom filter and a footer that tells where they are. `lookup` reads the footer, asks the filter, finds the block by
binary search and reads that block alone.

Shard layout (all numbers little-endian)
  block    zstd of entries: u8 shared key bytes, u8 other key bytes, u32 value bytes, key rest, value
  index    u32 blocks; for each: u8 key bytes, last key, u64 offset, u32 bytes, u32 entries, u32 crc32
  filter   u32 bits, u8 hashes, bits
  footer   u64 index offset, u32 index bytes, u64 filter offset, u32 filter bytes, u64 documents, u64 tokens, 8-byte magic
  value    u8 bytes an id (2 if all fit, else 4), ids
  key      0x00 for a null id, else 0x01 and the id as 8 big-endian bytes with the sign bit turned

Rows are dealt to shards by ranges of (doc_id, text hash), so a repeated id can span shards. Files are written under a
name of their own for each attempt and count only once the manifest names them. spark.checkpoint.dir is reached through
pyarrow's file systems (local, HDFS, object stores).

Defined cases: a null text is the end id alone; a null doc_id sorts first; rows that repeat an id are all kept, in order
of their text's hash; an empty table gives no shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm._common import Out, buckets, materialise, new_path, rows_of
from proofline.llm.vocab import codec, resolve

MAGIC = b"PLSSTAB1"
FOOTER = struct.Struct("<QIQIQQ8s")
MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("docs", pa.int64()), ("tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def file_system(uri: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one shard; keys must not fall."""

    def __init__(self, sink, block_bytes: int = 1 << 16, bits_a_key: int = 10):
        import zstandard

        self.sink, self.block_bytes, self.bits = sink, block_bytes, bits_a_key
        self.squeeze = zstandard.ZstdCompressor(level=1).compress
        self.at = self.docs = self.tokens = self.entries = 0
        self.block, self.last, self.first = bytearray(), b"", None
        self.index: list[bytes] = []
        self.hashes: list[int] = []

    def add(self, key: bytes, ids: bytes) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys fall")
        wide = np.frombuffer(ids, "<u4")
        value = b"\4" + ids if wide.size and wide.max() > 0xFFFF else b"\2" + wide.astype("<u2").tobytes()
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        self.first = key if self.first is None else self.first
        self.last, self.entries, self.docs, self.tokens = key, self.entries + 1, self.docs + 1, self.tokens + wide.size
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.sink.write(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.entries:
            data = self.squeeze(bytes(self.block))
            at, size = self._put(data)
            self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<QIII", at, size, self.entries, zlib.crc32(data)))
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = self._put(struct.pack("<I", len(self.index)) + b"".join(self.index))
        size, rounds = max(64, len(self.hashes) * self.bits), 7
        bits = np.zeros(size, bool)
        h = np.array(self.hashes, np.uint64)
        for i in range(rounds):
            bits[((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32))) % np.uint64(size)] = True
        bloom = self._put(struct.pack("<IB", size, rounds) + np.packbits(bits, bitorder="little").tobytes())
        self._put(FOOTER.pack(*index, *bloom, self.docs, self.tokens, MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        import zstandard

        self.source, self.expand = source, zstandard.ZstdDecompressor().decompress
        index_at, index_size, self.bloom_at, self.bloom_size, self.docs, self.tokens, magic = FOOTER.unpack(self._at(source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data = self._at(index_at, index_size)
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        at = 4
        for _ in range(struct.unpack_from("<I", data)[0]):
            size = data[at]
            self.keys.append(data[at + 1 : at + 1 + size])
            self.blocks.append(struct.unpack_from("<QIII", data, at + 1 + size))
            at += 21 + size

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        """(key, ids) of a block."""
        at, size, entries, crc = self.blocks[n]
        data = self._at(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        data, at, key = self.expand(data), 0, b""
        for _ in range(entries):
            shared, other, size = struct.unpack_from("<BBI", data, at)
            key = key[:shared] + data[at + 6 : at + 6 + other]
            at += 6 + other
            value, at = data[at : at + size], at + size
            yield key, value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()

    def rows(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.blocks)):
            yield from self.block(n)

    def may_hold(self, key: bytes) -> bool:
        data = self._at(self.bloom_at, self.bloom_size)
        size, rounds = struct.unpack_from("<IB", data)
        h = xxhash.xxh64_intdigest(key)
        spots = (((h & 0xFFFFFFFF) + i * (h >> 32)) % size for i in range(rounds))
        return all(data[5 + s // 8] >> s % 8 & 1 for s in spots)

    def get(self, doc_id: int | None) -> list[bytes]:
        """ids of each document with this id."""
        key, found = key_of(doc_id), []
        if self.blocks and self.may_hold(key):
            n = bisect.bisect_left(self.keys, key)
            while n < len(self.blocks):
                found += [ids for k, ids in self.block(n) if k == key]
                if self.keys[n] > key:
                    break
                n += 1
        return found


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Tokenise `docs(doc_id, text)` and write shards; returns the manifest, written and read back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "sstable")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange(shards or buckets(spark), "doc_id", "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids_of, end = TaskContext.get().partitionId(), codec(resolve(vocabulary)), array("I", [end_id]).tobytes()
        files, folder = file_system(path)
        writer = sink = None
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            if writer is None:
                files.create_dir(folder, recursive=True)
                name = f"shard-{shard:07d}-{uuid.uuid4().hex}.sst"
                sink = files.open_output_stream(f"{folder}/{name}")
                writer = Writer(sink)
            writer.add(key_of(doc_id), ids_of.text(text) + end)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/{name}", "first_key": writer.first, "last_key": writer.last, "docs": writer.docs, "tokens": writer.tokens}], schema=MANIFEST)

    return materialise(ranged.mapInArrow(save, "shard int, path string, first_key binary, last_key binary, docs long, tokens long"), "manifest")


def read(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Documents of the shards that a manifest names, with the count of ids before each."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))  # one row a shard

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in rows_of(batches, "path", "base"):
            files, at = file_system(path)
            out = Out(READ)
            with files.open_input_file(at) as source:
                for key, ids in Reader(source).rows():
                    out.add(id_of(key), start, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None)
                    start += len(ids) // 4
                    yield from out.ready()
            yield from out.ready(force=True)

    return based.repartition(buckets(spark), "shard").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[bytes]:
    """ids of the documents with one id, from the shards whose key range holds it."""
    key, found = key_of(doc_id), []
    for row in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard").select("path").toLocalIterator():
        files, at = file_system(row.path)
        with files.open_input_file(at) as source:
            found += Reader(source).get(doc_id)
    return found
