"""Operator 10 against brute force."""

import random
import string

import numpy as np
import pytest

from proofline.llm import shingle_join


def brute(rows):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "").replace("\x1c", "").replace("\x85", "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(d, lowest.get(root(i), d))
    return sorted((str(d), len(s), str(lowest.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def variants(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [rng.choice(string.ascii_letters) + str(rng.randrange(10_000)) for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"z{rng.randrange(10**9)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_join(spark, sf, block):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    texts = [None, "", " \n", "one", "One", "a b c d", "A B C D", "a b c d e", "a b c d e f", "x\x1cy z", "x y z"]
    for n, (words, copies, edits) in enumerate([(9, 12, 2), (20, 20, 2), (60, 40, 4), (150, 60, 9), (400, 40, 22), (3000, 10, 150), (33, 30, 2), (70, 30, 3)]):
        texts += variants(n, words, copies, edits)
    line = "this very common line stands in many short documents of the corpus and never ends well"
    texts += [f"{line} {w}" for w in ("a", "b", "c d", "e f g", "h i j k l m n", "o p q r s t u v w x y z")]
    rows += [(1000 + i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (7, texts[-2]), (7, texts[-2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as component_id")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in shingle_join.join(df, block=block).collect())
    assert got == brute(rows)
    if block == 4:  # nearly all sets share their first hash with others
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in shingle_join.join(df, bits=6).collect())
        assert got == brute(rows)
    assert shingle_join.join(df.limit(0)).count() == 0


def test_families_of_several_blocks(spark):
    """At the block size of the query: copies around one text, a chain in which only near members link, and texts with most words in common."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    around = variants(11, 40, 299, 3)
    chain = [" ".join(words[2 * i : 2 * i + 60]) for i in range(560)]
    common = " ".join(words[:12])
    unlike = [" ".join(x for w in words[:12] for x in (w, f"n{i}")) + " " + common for i in range(60)]
    rows = list(enumerate([*around, *chain, *unlike]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in shingle_join.join(df).collect())
    assert got == brute(rows)
    assert {c for d, _, c in got if 300 <= int(d) < 860} == {"300"}


def test_distance_bound():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[n // 20 :], rng.integers(0, 2**63, n // 20).astype(np.uint64)))
        for (t, _, x), (u, _, y) in zip(shingle_join.sketches(a), shingle_join.sketches(b), strict=False):
            if t == u < 1000:
                assert len(np.setdiff1d(x, y)) <= len(np.setxor1d(a, b))



def test_large_family_costs_its_rest(spark):
    """A family of copies around one text: a comparison a member with each pivot, and none between blocks."""
    rows = list(enumerate(variants(5, 200, 120, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(1, shingle_join.class_of(s), len(rows), shingle_join.squeeze(s.tobytes())) for s in shingle_join.shingle_sets([t for _, t in rows])]
    sets = list({s[1]: s for s in sets}.values())
    members = spark.createDataFrame(sets, "root long, cls long, members long, packed binary")
    links = shingle_join._links(members, 8).collect()
    assert len(links) <= shingle_join.PIVOTS * len(sets)
    assert {r.component_id for r in shingle_join.join(df, block=8).collect()} == {0}


def test_hot_keys(spark, monkeypatch):
    from proofline.operators import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    rows = [(i, "one two three four five six seven eight nine ten " + ("x" if i % 9 else f"y{i}")) for i in range(200)] + [(500 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in shingle_join.join(df).collect())
    assert got == brute(rows)
    assert sorted(r.doc_id for r in shingle_join.keep_one(df).collect()) == sorted({c for _, n, c in ((d, n, int(c)) for d, n, c in brute(rows)) if n} | {500 + i for i in range(9)})


def test_hubs(spark):
    """Members that share many leaders give about a link each, and connect as before."""
    from proofline.operators.graph import components

    pairs = [(100 + a, b) for a in range(300) for b in range(20)] + [(1000, 50), (1000, 51)]
    links = spark.createDataFrame(pairs, "a long, b long")
    few = shingle_join.hubs(links)
    assert few.count() == 300 + 19 + 2
    assert sorted(map(tuple, components(few).collect())) == sorted(map(tuple, components(links).collect()))
