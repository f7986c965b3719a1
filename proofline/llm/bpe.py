"""Operator 2: BPE encoding and decoding over a distinct-word table.

Method. Documents are cut into blocks of a few MB. Each block hands out its distinct words, dealt by a hash; every
distinct word of the corpus meets in one bucket and is encoded once. The ids of a block's words come back to the block
in the order of its word list and are joined to the text by position. Decoding maps ids through the id-to-piece table,
whose size is the vocabulary's. A word is a run between ASCII white space, at which the vocabulary always splits.

The blocks are written once, compressed, to files in the shared folder, and a table tells where each lies. What hands out
words and what joins ids back both read the blocks from there, so the input may come from a shuffle, in any order, and a
retried task finds the same blocks. Texts are not shuffled.

Defined cases: a null text counts as empty (no ids, the hash of the empty string); repeated rows each give a row;
an empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import Out, buckets, materialise, new_path, rows_of, sized
from proofline.llm.sstable import file_system
from proofline.llm.vocab import codec, pieces, resolve, words

BLOCK_CHARS = 6_000_000
BUCKET_BYTES = 32 << 20  # of compressed text, whose distinct words a bucket has to hold
WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("packed", pa.binary())])
PLACES = pa.schema([("block", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def squeeze(data: bytes, level: int = 1) -> bytes:
    """Compressed bytes for a shuffle."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_docs(rows: list[tuple]) -> bytes:
    """Rows of (doc_id, text) as Arrow IPC bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, DOCS) as to:
        to.write_batch(pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_string())], schema=DOCS))
    return sink.getvalue().to_pybytes()


def unpack_docs(data: bytes) -> tuple[list, list]:
    with pa.ipc.open_stream(data) as stream:
        t = stream.read_all()
    return t.column(0).to_pylist(), t.column(1).to_pylist()


def write_blocks(docs: DataFrame, path: str, chars: int) -> DataFrame:
    """Write `docs(doc_id, text)` in blocks, a file a task: block, path, offset, length of each."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        sink, at, out = None, 0, Out(PLACES)
        for rows in sized(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or ""), chars):
            if sink is None:
                files.create_dir(folder, recursive=True)
                name = uuid.uuid4().hex
                sink = files.open_output_stream(f"{folder}/{name}", compression=None)
            data = squeeze(pack_docs(rows), 3)
            sink.write(data)
            out.add(f"{name} {at}", f"{path}/{name}", at, len(data))
            at += len(data)
        if sink:
            sink.close()
        yield from out.ready(force=True)

    return materialise(docs.mapInArrow(save, "block string, path string, offset long, length long"), "block-places")


def read_block(path: str, offset: int, length: int) -> tuple[list, list]:
    """Ids and texts of a block."""
    files, at = file_system(path)
    with files.open_input_file(at) as source:
        source.seek(offset)
        return unpack_docs(expand(source.read(length)))


def distinct_words(texts: list[str | None]) -> dict[str, int]:
    """A block's words, numbered in the order of their first place."""
    found: dict[str, int] = {}
    for text in texts:
        if text:
            for w in words(text):
                if w not in found:
                    found[w] = len(found)
    return found


def bucket_of(word: str, parts: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % parts


def encode(docs: DataFrame, vocabulary: str, hashes_only: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode and decode `docs(doc_id, text)`: doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded.

    vocabulary: path of a tokenizers file whose words end at white space, or the name of a public one.
    hashes_only: leave ids and decoded null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    places = write_blocks(docs, new_path(spark, "blocks"), block_chars)
    n_blocks, size = places.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(buckets(spark), -(-size // BUCKET_BYTES))

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, path, offset, length in rows_of(batches, "block", "path", "offset", "length"):
            dealt: dict[int, list[str]] = {}
            for w in distinct_words(read_block(path, offset, length)[1]):
                dealt.setdefault(bucket_of(w, parts), []).append(w)
            out = Out(WORDS)
            for bucket, held in sorted(dealt.items()):
                out.add(bucket, block, squeeze(" ".join(held).encode("utf-8", "surrogatepass")))
            yield from out.ready(force=True)

    def encode_bucket(table: pa.Table) -> pa.Table:
        ids = codec(resolve(vocabulary))
        known: dict[str, bytes] = {}
        out: list[bytes] = []
        for packed in table.column("packed"):
            held = expand(packed.as_py()).decode("utf-8", "surrogatepass").split(" ")
            found = []
            for w in held:
                x = known.get(w)
                if x is None:
                    x = known[w] = ids.chunk(w)
                found.append(x)
            sizes = np.fromiter((len(x) // 4 for x in found), np.uint32, len(found))
            own = np.frombuffer(b"".join(found), "<u4")
            kinds = ["<u1" if sizes.max(initial=0) < 256 else "<u4", "<u2" if own.max(initial=0) < 65536 else "<u4"]
            out.append(squeeze(np.array([len(found), *(int(k[2]) for k in kinds)], "<u4").tobytes() + sizes.astype(kinds[0]).tobytes() + own.astype(kinds[1]).tobytes(), 3))
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "packed": pa.array(out, pa.binary())}, schema=WORDS)

    def join_back(texts: pa.Table, coded: pa.Table) -> pa.Table:
        names = pieces(resolve(vocabulary))
        numbers = list(map(str, range(len(names))))
        lists = {b: expand(p) for b, p in zip(coded.column("bucket").to_pylist(), coded.column("packed").to_pylist(), strict=True)}
        done = []
        for _, path, offset, length in rows_of(texts.to_batches(), "block", "path", "offset", "length"):
            doc_ids, held = read_block(path, offset, length)
            order: dict[int, list[str]] = {}
            for w in distinct_words(held):
                order.setdefault(bucket_of(w, parts), []).append(w)
            number_text, piece_text, counts, ids_of = {}, {}, {}, {}
            for bucket, of in order.items():
                data = lists[bucket]
                n, small, wide = np.frombuffer(data, "<u4", 3).tolist()
                sizes = np.frombuffer(data, f"<u{small}", n, 12)
                ids = np.frombuffer(data, f"<u{wide}", offset=12 + small * n).tolist()
                at = 0
                for w, size in zip(of, sizes.tolist(), strict=True):
                    own = ids[at : at + size]
                    at += size
                    if size:
                        number_text[w] = " ".join([numbers[i] for i in own])
                        piece_text[w] = " ".join([names[i] for i in own])
                    counts[w] = size
                    if not hashes_only:
                        ids_of[w] = own
            out = Out(ENCODED, 1 << 30)
            for doc_id, text in zip(doc_ids, held, strict=True):
                parted = words(text) if text else []
                joined = " ".join([piece_text[w] for w in parted if counts[w]])
                out.add(
                    doc_id, sum([counts[w] for w in parted]), hashlib.sha256(" ".join([number_text[w] for w in parted if counts[w]]).encode()).hexdigest(),
                    hashlib.sha256(joined.encode()).hexdigest(), None if hashes_only else [i for w in parted for i in ids_of[w]], None if hashes_only else joined,
                )
            done += out.ready(force=True)
        return pa.Table.from_batches(done, schema=ENCODED)

    tasks = max(1, min(n_blocks, buckets(spark)))
    dealt = places.repartition(tasks).mapInArrow(hand_out, "bucket int, block string, packed binary")
    coded = dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(encode_bucket, "bucket int, block string, packed binary")
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_back, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
