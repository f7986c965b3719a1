"""Operators 11 and 12 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from proofline.llm import centroids, whitening
from proofline.llm.queries import queries

ODD = [(None, [0.25] * 64), (90_001, None), (90_002, [None] * 64), (90_003, [float("nan")] * 64), (90_004, [float("inf")] + [0.0] * 63), (90_005, []), (90_007, [-0.0] * 64)]


def tied_rows(spark, sf):
    """The table with odd rows, repeated ids, repeated vectors and one vector that a third of all rows hold."""
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += ODD + [rows[3], (rows[4][0], rows[5][1])] + [(100_000 + i, rows[7][1]) for i in range(250)]
    return rows, spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(7)


def whole(rows, scale, length=None):
    return [(i, np.floor(np.array(v, float) * scale).astype(np.int64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and length in (None, len(v))]


def lloyd(rows, k, rounds):
    """Plain Lloyd in Python integers: every vector against every centroid, sums anew in each round."""
    rows = [(i, x.tolist()) for i, x in whole(rows, 256, 64)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, x) for i, x in rows if i is not None)[:k]
    now = [x for _, _, x in seeds]

    def assign():
        c = np.array(now, object)
        return [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), n) for n, m in enumerate(c.tolist())) for _, x in rows]

    for _ in range(rounds):
        own = assign()
        for n in range(len(now)):
            mine = [x for (_, x), (_, o) in zip(rows, own, strict=True) if o == n]
            if mine:
                now[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    inertia = Counter()
    for d, n in own:
        inertia[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), names[n]) for (i, _), (d, n) in zip(rows, own, strict=True))


@pytest.mark.parametrize(("k", "rounds", "block"), [(40, 5, 4096), (5, 3, 7), (1, 2, 64), (12, 0, 50)])
def test_clusters(spark, sf, k, rounds, block):
    rows, df = tied_rows(spark, sf)
    got = centroids.cluster(df, k=k, rounds=rounds, block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == lloyd(rows, k, rounds)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (1, [1.0] * 64), (2, [2.5] * 64), (3, [1.0])], "vec_id int, embedding array<float>")
    assert Counter(map(tuple, centroids.cluster(df).collect())) == lloyd([(r[0], list(r[1])) for r in df.collect()], 40, 5)
    for empty in (df.limit(0), df.where("vec_id = 3"), spark.createDataFrame([(None, None)], "vec_id long, embedding array<double>")):
        assert centroids.cluster(empty).collect() == []
    with pytest.raises(Exception, match="exact sums need"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(2**27) + 1, 2**27, (50, 64)), rng.integers(-(2**27) + 1, 2**27, (7, 64))
    best, d = centroids.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, m, strict=True)), n) for n, m in enumerate(c)) for r in x]
    assert list(zip(d.tolist(), best.tolist(), strict=True)) == want


def test_delta_rounds_compare_little():
    """Rows whose owner stayed are compared with the moved centroids only, and get what a full comparison gives."""
    rng = np.random.default_rng(2)
    x, c = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (12, 4))
    owner, distance = centroids.nearest(x, c)
    c2 = c.copy()
    c2[[3, 8]] += 1
    got = centroids.advance(x, owner, distance, c2, np.array([3, 8]))
    assert all((a == b).all() for a, b in zip(got, centroids.nearest(x, c2), strict=True))
    sums = sum(np.array(t["sums"]) for t in centroids.transfers(x, owner, got[0], 12))
    assert (sums == 0).all() and sum(t["n"] for t in centroids.transfers(x, owner, got[0], 12)) == 0


def expect_whitened(rows, got, components=4):
    for d in {len(x) for _, x in whole(rows, 256)}:
        mine = [(i, x) for i, x in whole(rows, 256) if len(x) == d]
        fit = np.array(sorted({tuple(x.tolist()) for _, x in mine}))
        n, sums = len(fit), fit.sum(0)
        centred = fit - sums / n
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1], axes[:, ::-1]
        kept = min(components, int((values > 1e-9 * values[0]).sum()) if values[0] > 0 else 0)
        out = [r for r in got if r.vec_id is None or r.vec_id in {i for i, _ in mine}]
        by = {(i, tuple(x.tolist())): sum(int(v) ** 2 for v in n * x - sums) for i, x in mine}
        if kept == 0:
            continue
        assert Counter((i, c + 1, n, by[i, tuple(x.tolist())]) for i, x in mine for c in range(kept)) == Counter((r.vec_id, r.component, r.n, r.deviation) for r in out)
        for c in range(kept):
            want = sorted((str(i), v) for (i, _), v in zip(mine, ((np.array([x for _, x in mine]) - sums / n) @ axes[:, c] / np.sqrt(values[c])).tolist(), strict=True))
            mine_got = [(str(r.vec_id), r.whitened) for r in out if r.component == c + 1]
            sign = next(s for s in (1, -1) if np.allclose([v for _, v in want], [v for _, v in sorted((i, s * v) for i, v in mine_got)], atol=1e-7))
            assert sign
            assert all(abs(r.explained - values[c] / values.sum()) < 1e-10 for r in out if r.component == c + 1)
        assert {r.identity_error for r in out if r.n == n} == {out[0].identity_error} and 0 <= out[0].identity_error < 1e-9


def test_whitening(spark, sf):
    rows, df = tied_rows(spark, sf)
    expect_whitened(rows, whitening.whiten(df).collect())


def test_whitening_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 5).tolist()) for i in range(40)] + [(i, rng.normal(0, 1, 2).tolist()) for i in range(50, 60)] + [(70, [1.0, 2.0, 3.0])] * 2
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()
    expect_whitened(rows[:40], [r for r in got if r.vec_id < 40])
    expect_whitened(rows[40:50], [r for r in got if 50 <= r.vec_id < 60])
    assert {r.component for r in got if r.vec_id >= 50} == {1, 2} and not [r for r in got if r.vec_id == 70]  # one distinct vector: no variance


def test_many_triangles_are_reduced_in_rounds(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    fitted = whitening.materialise(whitening.fit_list(df).repartition(40), "wide")
    [(d, r)] = whitening.triangles(fitted, whitening.totals(fitted), fan=2).items()
    x = np.array(whole([(0, list(v.embedding)) for v in df.collect()], 256), object)[:, 1]
    x = np.unique(np.stack(x), axis=0)
    c = x - x.mean(0)
    assert d == 6 and np.allclose(r.T @ r, c.T @ c)


@pytest.mark.parametrize("d", [1, 2, 5, 8, 64])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(0, 1, (d, d))) * np.logspace(0, -6, d)
    sizes, v = whitening.jacobi(r)
    assert np.allclose(sizes, np.linalg.svd(r)[1], rtol=1e-12) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose(np.linalg.norm(r @ v, axis=0), sizes)


def test_deviations_beyond_64_bits_are_null():
    m = whitening.Whitening(10**9, [5, -7 * 10**9], np.eye(2), np.ones(2), 2.0)
    got = m.deviations(np.array([[300, -200], [0, -7]]))
    assert got == [None, 25] or got == [None, (10**9 * 0 - 5) ** 2]


def test_odd_tables_and_queries(spark, sf):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    assert queries()["op11_whitening"](spark, sf).count() == 2000 and queries()["op12_centroids"](spark, sf).count() == 500
