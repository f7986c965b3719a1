"""Work within one key over sorted ranges, sets within sets, and chains of close values, against rules walked one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import evidence, precedence, series


@pytest.mark.parametrize("pattern", [None, "^#"])
def test_blocks_of_lines(spark, pattern):
    rng = random.Random(3)
    texts = {k: "\n".join(rng.choice(["", "# head", "x" * rng.randrange(1, 40), "y" * rng.randrange(1, 9)]) for _ in range(n)) for k, n in (("hot", 400), ("b", 1), ("c", 30), ("d", 2))}
    texts["e"] = "z" * 300 + "\n" + "w" * 100 + "\nshort\n" + "v" * 101
    whole = spark.createDataFrame(list(texts.items()), "k string, text string")
    lines = spark.createDataFrame([(k, n, x) for k, t in texts.items() for n, x in enumerate(t.split("\n"))], "k string, n long, line string").repartition(7)
    want = {tuple(r) for r in evidence.blocks(whole, "k", cap=100, starts_block=pattern).select("k", "block", "first_line", "last_line", "locator", "chunk").collect()}
    got = evidence.blocks_of_lines(lines, "k", "n", cap=100, starts_block=pattern).select("k", "block", "first_line", "last_line", "locator", "chunk").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert evidence.blocks_of_lines(lines.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("limit", ["WHOLE_LINES", "WHOLE_CHARS"])
def test_blocks_of_short_and_long_sources(spark, monkeypatch, limit):
    rng = random.Random(4)
    texts = {k: "\n".join("x" * rng.randrange(0, 30) for _ in range(n)) for k, n in (("long", 90), ("long2", 70), ("a", 5), ("b", 1), ("c", 12))} | {None: "one\n\ntwo"}
    lines = spark.createDataFrame([(k, n, x or None) for k, t in texts.items() for n, x in enumerate(t.split("\n"))], "k string, n long, line string").repartition(5)
    want = {tuple(r) for r in evidence.blocks(spark.createDataFrame(list(texts.items()), "k string, text string"), "k", cap=60).select("k", "block", "first_line", "last_line", "locator", "chunk").collect()}
    seen, ruled = [], evidence.ruled_blocks
    monkeypatch.setattr(evidence, limit, 40 if limit == "WHOLE_LINES" else 600)
    monkeypatch.setattr(evidence, "ruled_blocks", lambda rows, *a: seen.extend(r.k for r in rows.select("k").distinct().collect()) or ruled(rows, *a))
    got = evidence.blocks_of_lines(lines, "k", "n", cap=60).select("k", "block", "first_line", "last_line", "locator", "chunk").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sorted(seen) == ["long", "long2"]  # every source went through the written ranges before


def test_sets_within_sets(spark):
    rng = random.Random(5)
    draw = lambda n: sorted({"common", *(f"a{rng.randrange(12)}" for _ in range(n))} if rng.random() < 0.9 else set())
    asked = [(f"c{i}", draw(rng.randrange(3))) for i in range(60)] + [("none", ["unknown"]), ("empty", [])]
    known = [(f"m{i:02}", draw(9)) for i in range(40)] + [("m90", known_set := ["common", "a1"]), ("m91", known_set * 2)]
    got = series.contained(spark.createDataFrame(asked, "id string, v array<string>"), spark.createDataFrame(known, "m string, w array<string>"))
    want = {}
    for c, v in asked:
        fits = [m for m, w in known if v and set(v) <= set(w)]
        if fits:
            want[c] = (len(fits), min(fits))
    assert {r.id: (r.n, r["first"]) for r in got.collect()} == want


def test_clusters_of_chains(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "k1", None]), rng.choice([rng.uniform(-2, 2), rng.randrange(4) + 0.06 * rng.randrange(8)]), i) for i in range(300)]
    got = precedence.clusters(spark.createDataFrame(rows, "k string, v double, o long").repartition(5), "k", "v", "o", 1e-3, 0.05).collect()
    want = []
    for k in ("hot", "k1", None):
        heads = []
        for v in dict.fromkeys(v for x, v, _ in rows if x == k):
            n = sum(r[:2] == (k, v) for r in rows)
            hit = next((h for h in heads if abs(h[0] - v) <= max(1e-3 * max(abs(h[0]), abs(v)), 0.05)), None)
            if hit:
                hit[1] += n
            else:
                heads.append([v, n])
        want += [(k, *h) for h in heads]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert not math.isnan(sum(r[1] for r in got))


def test_headings_and_newest_first(spark):
    rows = [("s", i, "H%d" % i if i % 17 == 3 else None) for i in range(100)] + [("t", 0, None)]
    got = {(r.s, r.n): r.section for r in evidence.headings(spark.createDataFrame(rows, "s string, n int, h string").repartition(6), "s", "n", "h").collect()}
    assert got == {(s, n): "H%d" % (n - (n - 3) % 17) if s == "s" and n >= 3 else None for s, n, _ in rows}
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 7, 3), ("a", 5, 1), ("b", None, 4)], "thread string, at int, pos int")
    assert {(r.thread, r.pos, r.at): r["rank"] for r in evidence.newest_first(df, "thread", "at", "pos").collect()} == {("a", 3, 7): 1, ("a", 1, 5): 2, ("a", 2, 5): 3, ("a", 1, None): 4, ("b", 4, None): 1}
    assert evidence.chunk_keys(df.select("thread", "pos"), "thread", "pos").where(F.col("pos") == 0).count() == 2
