"""Operator 12: k-means by delta rounds (Lloyd), over integers.

Method. Vectors lie in blocks with each vector's owner and its squared distance to it; that state is written each round.
The driver holds the centroids and each cluster's integer sum and count. In a round, vectors whose owner moved are
compared with all centroids; all others keep their distance and are compared with the moved centroids only. Each block
notes the signed transfers of what changed its owner (plus for the new cluster, minus for the old); only these are summed,
and added to the sums. Nothing is shuffled but the transfers, at most a row for each cluster, component and task.

All arithmetic is in whole numbers: products of doubles are used only where their bound is below 2^53.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; a row
without vec_id is clustered but is no start; repeated ids and vectors are rows of their own (equal hashes: the smaller
vector first); with fewer vectors than k there are as many clusters as vectors, and an empty table gives no rows; integers
of 2^27 or more raise ValueError (their squared distances pass 64 bits); an inertia beyond 64 bits is null. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import storage
from proofline.llm._common import lean
from proofline.llm.vectors import matrices, narrow, packed, wide

SCALE, LARGEST, BLOCK = 256, 1 << 27, 4096
MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
STATE = pa.schema([("ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("owner", pa.list_(pa.int32())), ("distance", pa.list_(pa.int64())), ("moved", MOVED)])
SHAPE = "ids array<long>, vecs binary, owner array<int>, distance array<long>, moved array<struct<cluster: int, n: long, sums: array<long>>>"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of whole numbers, in doubles if every partial sum fits."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of several, and the squared distance."""
    if not len(x) or not len(centroids):
        return np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    d = (x * x).sum(1)[:, None] - 2 * product(x, centroids.T) + (centroids * centroids).sum(1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def advance(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances after the centroids in `moved` have moved; owner -1 has none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = np.isin(owner, moved) | (owner < 0)
    owner[lost], distance[lost] = nearest(x[lost], centroids)
    stay = np.flatnonzero(~lost)
    best, d = nearest(x[stay], centroids[moved])
    best = moved[best] if len(moved) else best
    nearer = (d < distance[stay]) | ((d == distance[stay]) & (best < owner[stay]))
    owner[stay[nearer]], distance[stay[nearer]] = best[nearer], d[nearer]
    return owner, distance


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """Signed counts and sums, by cluster, of the rows whose owner differs."""
    at = np.flatnonzero(before != after)
    clusters = np.arange(k)[:, None]
    sign = (after[at] == clusters).astype(np.int64) - (before[at] == clusters)
    sums, counts = product(sign, x[at]), sign.sum(1)
    return [{"cluster": c, "n": int(counts[c]), "sums": sums[c].tolist()} for c in np.flatnonzero((sign != 0).any(1)).tolist()]


def blocks(vectors: DataFrame, length: int, scale: int, block: int) -> DataFrame:
    """The first state: vectors in blocks, without owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for rows, x in matrices(batch.column(1), scale, LARGEST, length):
                ids = batch.column(0).take(pa.array(rows)).to_pylist()
                for at in range(0, len(x), block):
                    part = x[at : at + block]
                    yield pa.RecordBatch.from_pylist([{"ids": ids[at : at + block], "vecs": narrow(part).tobytes(), "owner": [-1] * len(part), "distance": [0] * len(part), "moved": []}], schema=STATE)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, SHAPE)


def starts(vectors: DataFrame, length: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1), scale, LARGEST, length):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(x)], names=["vec_id", "x"])

    known = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").mapInArrow(run, "vec_id long, x binary")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = known.orderBy(order, "vec_id", "x").limit(k).collect()
    return np.vstack([wide(r.x, length, 1) for r in found]) if found else np.zeros((0, length), np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, length: int = 64, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for the vectors of `vectors(vec_id, embedding)` with `length` components."""
    spark = vectors.sparkSession
    centroids = starts(vectors, length, scale, k, seed)
    k = len(centroids)
    sums, counts = [[0] * length for _ in range(k)], [0] * k
    moved = np.arange(k)

    def step(now: np.ndarray, changed: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            for batch in batches:
                for i in range(batch.num_rows):
                    [row] = batch.slice(i, 1).to_pylist()
                    x = wide(row["vecs"], length, len(row["ids"]))
                    before = np.array(row["owner"])
                    after, distance = advance(x, before, np.array(row["distance"]), now, changed)
                    row |= {"owner": after.tolist(), "distance": distance.tolist(), "moved": transfers(x, before, after, k)}
                    yield pa.RecordBatch.from_pylist([row], schema=STATE)

        return run

    state, old = blocks(vectors, length, scale, block), None
    for n in range(rounds + 1):
        path = storage.new_path(spark, "clusters")
        state.mapInArrow(step(centroids, moved), SHAPE).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if old:
            storage.discard(spark, old)  # the round before it, which nothing reads any more
        old = path
        if n == rounds:
            break
        each = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("place", "s"))
        for c, place, count, s in each.groupBy("cluster", "place").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect():  # k times length
            sums[c][place] += int(s)
            counts[c] += count if place == 0 else 0
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64).reshape(k, length)
        moved = np.flatnonzero((new != centroids).any(1))
        centroids = new
        if not len(moved):  # every later round would find the same
            break
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = state.select(F.explode(F.arrays_zip("ids", "owner", "distance")).alias("r")).select(F.col("r.ids").alias("vec_id"), F.col("r.owner").alias("cluster"), "r.distance")
    whole = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    fits = lambda v: v if v < 2**63 else None
    table = spark.createDataFrame([(c, fits(s), fits(sum(whole.values())), names[c]) for c, s in whole.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
