"""Operator 5: exact top-k search by a Voronoi join.

Method. A bounded set of pivots (the vectors with the smallest id hashes) cuts space into cells. Data are dealt to their
nearest pivot's cell and packed, in the order of their distance to it, into blocks; queries are grouped by the nearest of
the first few pivots. Summaries are bounded: of each cell the few smallest distances to its pivot, of each query group its
radius. They give every group a floor: the score that k rows beside the query's own surely reach. A row is replicated to a
group only if its upper bound reaches the group's floor; a block as a whole is tried first, with its own centre and radius.
Blocks are multiplied locally and the candidates of each query are merged.

With inner products q.x, for |q - a| <= r and |x - b| <= s: |q.x - a.b| <= r|b| + s|a| + rs; for a row itself s is 0, and
q.x <= a.x + r|x|. Pivots and groups are parameters, so what the driver holds does not grow; blocks and queries stay
distributed, and a hot cell spans many blocks. Vectors without any structure cannot be pruned (see the README).

Defined cases: vectors that are null, empty, hold a null or non-finite component, or have a null id take no part; a
query's own row is every row with its id; a query that is repeated in full counts once, other rows that repeat an id are
candidates of their own; only vectors of the query's length are compared; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm._common import Out, buckets, materialise, rows_of

PIVOTS, GROUPS, BLOCK = 64, 8, 2048
ROUNDING = 1e-12  # of a floating inner product, against the lengths
ROW = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("dist", pa.float64()), ("vec_id", pa.int64()), ("vec", pa.binary())])
PACKED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("salt", pa.int32()), ("radius", pa.float64()), ("near", pa.list_(pa.float64())), ("ids", pa.binary()), ("vecs", pa.binary())])
SENT = pa.schema([("dim", pa.int32()), ("grp", pa.int32()), ("salt", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and the vector as little-endian 64-bit integers floor(scale * x), without rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())]))
        for vec_id, vector in rows_of(batches, "vec_id", "embedding"):
            if vec_id is None or not vector or None in vector:
                continue
            x = np.floor(np.array(vector, np.float64) * scale)
            if np.isfinite(x).all():
                out.add(vec_id, len(x), x.astype("<i8").tobytes())
            yield from out.ready()
        yield from out.ready(force=True)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, dim int, vec binary")


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row, by Euclidean distance."""
    return np.argmin((pivots * pivots).sum(1) - 2 * (x @ pivots.T), 1) if len(x) else np.zeros(0, int)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises OverflowError beyond 64 bits


def matrix(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vecs, "<i2" if len(vecs) == 2 * dim * len(i) else "<i8").reshape(len(i), dim).astype(np.int64)


def packed_bytes(x: np.ndarray) -> bytes:
    return (x.astype("<i2") if np.abs(x).max(initial=0) < 32768 else x.astype("<i8")).tobytes()


@dataclass
class Plan:
    """Data blocks and query blocks, and what of the data each query group needs."""

    data: DataFrame
    asked: DataFrame
    floors: dict[int, list[tuple[int, np.ndarray, float, float]]]  # by dimension: group, centre, radius, floor
    salts: int

    def replicas(self) -> DataFrame:
        """(dim, grp, salt, ids, vecs): the rows of each block that each group needs."""
        floors = self.floors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Out(SENT, 16)
            for dim, salt, ids, vecs in rows_of(batches, "dim", "salt", "ids", "vecs"):
                i, x = matrix(ids, vecs, dim)
                f = x.astype(np.float64)
                size = np.sqrt((f * f).sum(1))
                middle = f.mean(0)
                radius, far = float(np.sqrt(((f - middle) ** 2).sum(1)).max()), float(np.linalg.norm(middle))
                for group, a, r, floor in floors.get(dim, []):
                    length = float(np.linalg.norm(a))
                    if a @ middle + (r * far + radius * length + r * radius) * (1 + 1e-9) + ROUNDING * far * length + 1 < floor:
                        continue
                    at = np.flatnonzero(f @ a + (r * (1 + 1e-9) + ROUNDING * length) * size + 1 >= floor)
                    if len(at):
                        out.add(dim, group, salt, i[at].tobytes(), packed_bytes(x[at]))
                yield from out.ready()
            yield from out.ready(force=True)

        return self.data.mapInArrow(run, "dim int, grp int, salt int, ids binary, vecs binary")


def prepare(vectors: DataFrame, queries, k: int = 10, pivots: int = PIVOTS, groups: int = GROUPS, block: int = BLOCK) -> Plan:
    """Cells, query groups and their floors for the rows of `vectors(vec_id, embedding)` that the condition `queries` picks."""
    spark = vectors.sparkSession
    parts = buckets(spark)
    base = materialise(quantise(vectors), "vectors")
    centres: dict[int, np.ndarray] = {}
    for row in base.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(pivots).collect():
        centres.setdefault(row.dim, []).append(np.frombuffer(row.vec, "<i8").astype(np.float64))
    centres = {d: np.unique(np.stack(c), axis=0) for d, c in centres.items()}
    own_rows = base.where(queries).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    least = k + own_rows  # rows with the query's id may all be among the nearest

    def own(dim: int, most: int) -> np.ndarray:
        return centres[dim][:most] if dim in centres else np.zeros((1, dim))

    def deal(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, ids, vecs = (batch.column(c).to_pylist() for c in ("dim", "vec_id", "vec"))
                cells, dist = np.zeros(len(ids), np.int32), np.zeros(len(ids))
                for dim in set(dims):
                    at = np.array([i for i, d in enumerate(dims) if d == dim])
                    x = np.frombuffer(b"".join(vecs[i] for i in at), "<i8").reshape(-1, dim).astype(np.float64)
                    cells[at] = nearest(x, own(dim, most))
                    dist[at] = np.sqrt(((x - own(dim, most)[cells[at]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(cells), pa.array(dist), pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], schema=ROW)

        return run

    def pack(size: int, salts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, held, now, made = Out(PACKED, 16), [], None, 0

            def close() -> None:
                nonlocal made
                if held:
                    dim, cell = now
                    x = np.frombuffer(b"".join(v for _, _, v in held), "<i8").reshape(-1, dim)
                    made += 1
                    out.add(dim, cell, (held[0][1] + made) % salts, held[-1][0], [d for d, _, _ in held[:least]], np.array([i for _, i, _ in held], "<i8").tobytes(), packed_bytes(x))

            for dim, cell, dist, vec_id, vec in rows_of(batches, "dim", "cell", "dist", "vec_id", "vec"):
                if now != (dim, cell) or len(held) >= size:
                    close()
                    held, now = [], (dim, cell)
                held.append((dist, vec_id, vec))
                yield from out.ready()
            close()
            yield from out.ready(force=True)

        return run

    def blocks(rows: DataFrame, most: int, n: int, salts: int, name: str) -> DataFrame:
        dealt = rows.mapInArrow(deal(most), "dim int, cell int, dist double, vec_id long, vec binary").repartitionByRange(n, "dim", "cell", "dist", "vec_id")
        return materialise(dealt.sortWithinPartitions("dim", "cell", "dist", "vec_id").mapInArrow(pack(block, salts), "dim int, cell int, salt int, radius double, near array<double>, ids binary, vecs binary"), name)

    salts = max(1, parts // groups)
    data = blocks(base, pivots, parts, salts, "cells")
    asked = blocks(base.where(queries).distinct(), groups, max(1, parts // 8), 1, "queries")
    place = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("d"))
    nearest_few = data.select("dim", "cell", F.explode("near").alias("d")).withColumn("place", place).where(F.col("place") <= least)  # `least` rows a cell
    cells = [(r.dim, r.cell, r.d) for r in nearest_few.collect()]
    floors: dict[int, list] = {}
    for dim, group, r in asked.groupBy("dim", "cell").agg(F.max("radius")).collect():  # a row a group
        a = own(dim, groups)[group]
        far, lows = np.linalg.norm(a), []
        for d, cell, s in cells:
            if d == dim:
                b = own(dim, pivots)[cell]
                lows.append(a @ b - (r * np.linalg.norm(b) + s * far + r * s) * (1 + 1e-9) - ROUNDING * far * (np.linalg.norm(b) + s) - 1)
        floors.setdefault(dim, []).append((group, a, r, sorted(lows, reverse=True)[least - 1] if len(lows) >= least else -np.inf))
    return Plan(data, asked, floors, salts)


def search(vectors: DataFrame, queries, k: int = 10, pivots: int = PIVOTS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products for the rows of `vectors(vec_id, embedding)` that
    the condition `queries` on vec_id picks, against all rows."""
    plan = prepare(vectors, queries, k, pivots, groups, block)
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.salts - 1))).alias("salt")
    right = plan.asked.select("dim", F.col("cell").alias("grp"), every, F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, vecs, q_ids, q_vecs in rows_of(batches, "dim", "ids", "vecs", "q_ids", "q_vecs"):
            i, x = matrix(ids, vecs, dim)
            qi, q = matrix(q_ids, q_vecs, dim)
            scores = product(q, x)
            out = Out(FOUND, 1 << 30)
            for j in range(len(qi)):
                s = scores[j]
                other = np.flatnonzero(i != qi[j])
                if len(other) > k:
                    kth = np.partition(s[other], len(other) - k)[len(other) - k]
                    other = other[s[other] >= kth]
                best = other[np.lexsort((i[other], -s[other]))][:k]
                key = int(np.frombuffer(hashlib.blake2b(q[j].tobytes(), digest_size=8).digest(), "<i8")[0])
                for b in best.tolist():
                    out.add(int(qi[j]), key, int(i[b]), int(s[b]))
            yield from out.ready(force=True)

    found = plan.replicas().join(right.hint("shuffle_merge"), ["dim", "grp", "salt"]).select("dim", "ids", "vecs", "q_ids", "q_vecs").mapInArrow(solve, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
