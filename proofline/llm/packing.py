"""Operator 8: harmonic packing of token documents into sequences of a fixed capacity.

Method. A document's ids are cut into whole sequences of `capacity` and a rest. A rest of length r belongs to class
k = capacity // r (its reciprocal-capacity class), whose sequences hold exactly k pieces. Where a slot of the class would
waste more than `waste` of r, the largest exact slot capacity // (k + 1) is cut off first and the remainder is classed
again, so that little padding is left. Each worker fills its own classes' sequences; no shuffle is needed and no count
is exchanged. What is left in a worker's open sequences at its end is laid end to end and cut at `capacity`, so that
each worker pads a single last sequence.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are documents of their own; an
empty table gives no sequence. Sequence ids are unique, not consecutive: the worker's partition times 2**32 plus a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import Out, rows_of
from proofline.llm.vocab import HELD, codec, resolve

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(tokens: int, capacity: int, waste: float) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces. Class k has sequences of k pieces."""
    out, at = [], 0
    while tokens - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while rest := tokens - at:
        k = capacity // rest
        slot = capacity // (k + 1)
        if slot and capacity / k - rest > waste * rest and k < 64:
            out.append((at, slot, k + 1))
            at += slot
        else:
            out.append((at, rest, k))
            at = tokens
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, waste: float = 0.02, keep_ids: bool = False, cached: int = HELD) -> DataFrame:
    """Pack `docs(doc_id, text)`: one row per piece, with its ids as little-endian unsigned 32-bit bytes if keep_ids.

    cached: how many words a worker caches."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, base, made = codec(resolve(vocabulary), cached), TaskContext.get().partitionId() << 32, 0
        end, out = end_id.to_bytes(4, "little"), Out(PIECES)
        open_: dict[int, list[tuple]] = {}

        def put(pieces: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for doc_id, start, ids, tokens in pieces:
                out.add(doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, base + made, offset, ids if keep_ids else None)
                offset += len(ids) // 4
            made += 1

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = ids_of.text(text) + end
            tokens = len(ids) // 4
            for start, length, k in cuts(tokens, capacity, waste):
                held = open_.setdefault(k, [])
                held.append((doc_id, start, ids[4 * start : 4 * (start + length)], tokens))
                if len(held) == k:
                    put(held)
                    open_[k] = []
            yield from out.ready()
        line: list[tuple] = []
        room = capacity
        for _, held in sorted(open_.items()):
            for doc_id, start, ids, tokens in held:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    line.append((doc_id, start, part, tokens))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        put(line)
                        line, room = [], capacity
        if line:
            put(line)
        yield from out.ready(force=True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fill, PACKED)
