"""Operators 3 and 5 against brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofline.llm import knn, warc
from proofline.llm.queries import queries


def test_warc(spark, sf):
    extra = [(None, "u", "same"), (90001, None, "same"), (90002, "a\nb", "same"), (90002, "b", "same"), (90003, "c", None), (90004, "d", ""), (None, "x", "alone"), (None, "y", "alone"), (90005, "long", "é" * 300_000)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rows = pages.collect()
    of = defaultdict(list)
    for r in rows:
        of[(r.html or "").encode()].append(r.page_id)
    want = Counter()
    for payload, ids in of.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(ids):
            want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if n else "response", ids[0] if n else None] += 1
    index = warc.write(pages)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect())
    assert got == want
    one = index.where("page_id = 90005 or url = 'long'")
    [back] = warc.read(one, keep_payload=True).collect()
    assert back.payload.decode() == "é" * 300_000 and back.url == "long"
    assert warc.write(pages.limit(0)).count() == 0
    assert {r[0] for r in warc.read(warc.write(pages, min_bytes=10**9)).select("record_type").collect()} == {"response"}


def test_warc_hot_payloads(spark, monkeypatch):
    """One payload with most rows, rows without ids among them, and rows that are wholly equal: each is written once, one as response."""
    monkeypatch.setattr(warc.skew, "LEAST", 5)
    monkeypatch.setattr(warc, "REPEATS", 7)
    rows = [(i, f"u{i}", "hot") for i in range(40)] + [(None, None, "hot")] * 9 + [(39, "u39", "hot")] * 30 + [(39, "other", "hot")] + [(None, "x", "bare")] * 16 + [(7, None, "cold")] * 2 + [(8, "y", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first").repartition(5)
    index = warc.write(df)
    got = warc.read(index, keep_payload=True).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((i, u) for i, u, _ in rows)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload) for r in got if r.record_type == "response") == [(False, 7, b"cold"), (False, 8, b"one"), (False, 39, b"hot"), (True, 0, b"bare")]
    assert all(r.refers_to == (39 if r.payload_bytes == 3 else None if r.page_id is None else 7) for r in got if r.record_type == "revisit")
    every = warc.write(df, min_bytes=4)
    assert warc.read(every).where("record_type = 'response'").count() == sum(h in ("hot", "one") for _, _, h in rows) + 2


def test_ranges():
    assert [(a, b, len(p)) for a, b, p in warc.ranges([(0, 10), (10, 10), (100, 5), (1000, 9)], gap=80, most=500)] == [(0, 105, 3), (1000, 1009, 1)]


@pytest.mark.parametrize("block", [7, 2048])
def test_knn(spark, sf, block):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += [(100_000, rows[3][1]), (100_001, rows[3][1]), (100_002, None), (100_003, [None] * 64), (100_004, [float("nan")] * 64), (None, rows[0][1]), (100_100, []), (100_200, [1.0, 2.0]), (100_201, [3.0, -1.0]), (100_300, [1e12] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    valid = [(i, np.floor(np.array(v) * 1024)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in valid:
        if i % 100 == 0 and i != 100_300:
            best = sorted(((-int(q @ x), j) for j, x in valid if j != i and len(x) == len(q)))[:10]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    got = knn.search(df, "vec_id % 100 = 0 and vec_id <> 100300", block=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert knn.search(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_knn_query(spark, sf):
    assert queries()["op5_knn"](spark, sf).count() > 0


def test_knn_with_many_rows_of_one_query_id(spark):
    """Rows that repeat a query's id fill a cell of their own; its neighbours lie in other cells."""
    rng = np.random.default_rng(4)
    rows = [(100, [-9.0, -9.0, -9.0])] * 60 + [(i, rng.normal(0, 1, 3).tolist()) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in rows]
    scores = sorted((-int(q[0][1] @ v), i) for i, v in q if i != 100)[:10]
    for pivots in (4, 64):
        got = sorted((r["rank"], r.vec_id, r.score) for r in knn.search(df, "vec_id % 100 = 0", pivots=pivots).collect())
        assert got == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_knn_prunes_clusters(spark):
    """Tight clusters: most rows go to no group but their own, and nothing is lost."""
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 1, (16, 24))
    rows = [(i, (middles[i % 16] + rng.normal(0, 0.02, 24)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = knn.prepare(df, "vec_id % 100 = 0", pivots=64, groups=64, block=16)
    sent = sum(len(r.ids) // 8 for r in plan.replicas().collect())
    groups = plan.asked.select("cell").distinct().count()
    assert groups >= 4 and sent <= 0.25 * groups * len(rows)
    q = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in rows]
    want = {(i, n, j, -s) for i, v in q if i % 100 == 0 for n, (s, j) in enumerate(sorted((-int(v @ x), j) for j, x in q if j != i)[:10], 1)}
    assert {tuple(r) for r in knn.search(df, "vec_id % 100 = 0", groups=64, block=16).collect()} == want
