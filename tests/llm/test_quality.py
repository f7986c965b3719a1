"""Operators 1 and 7: counts against brute force, learning by held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from proofline.llm import quality_rules, ranking
from proofline.llm.queries import queries
from proofline.llm.textstats import count

ODD = [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x\n\nx\nx \nx", "é # * $ %&|<>", "one two three four five six " * 30, "\x1cfoo\x85bar baz", "w " * 60_000, "l1 l2 l3\nl1 l2 l3\r\n"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    c = count(texts)
    got = list(zip(*(x.tolist() for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)), strict=True))
    assert got == [brute(t) for t in texts]


def test_quality_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None, "x"), (900, "", "y"), (900, "", "y"), (901, "good words " * 10, "z")], "doc_id long, text string, Quality string")
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.score(odd, model).collect()
    assert len(rows) == 4 and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    for r in queries()["op7_quality_rules"](spark, sf).join(docs, "doc_id").collect():
        n, chars, symbols, dup, rep = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.kept or not r.base_failed)
    assert quality_rules.score(odd.where("false"), model).count() == 0
    nothing = quality_rules.fit(docs, labels.where("quality = 1"))
    good = quality_rules.score(docs, nothing).where("not base_failed")
    assert good.where("kept").count() == good.count()


def test_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()["op1_ranking"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = np.array([s for s, _, y in held if y]), np.array([s for s, _, y in held if not y])
    assert np.mean([p == y for _, p, y in held]) >= 0.93 and (pos[:, None] > neg[None]).mean() >= 0.97


@pytest.mark.parametrize("model", [None])
def test_ranking_edges(spark, model):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a")], "doc_id long, text string").selectExpr("*", "1 as score")
    rows = ranking.score(df, model).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5} and not [r for r in rows if r.doc_id is None][0].held_out
    x = ranking.features([None, "", "a", "b c\nd", "z" * 1000])
    assert x.shape[0] == 5 and np.isfinite(x).all()


def test_bradley_terry_against_the_full_likelihood():
    """The weights against Newton's solution over all pairs, the cut against the quantile, the slope against a fine grid."""
    rng = np.random.default_rng(3)
    y = np.repeat([1, 0], [50, 70])
    x = rng.normal(0, 1, (120, 4)) * [1, 5, 0.1, 2] + np.outer(y, [1.2, -4, 0.05, 0])
    model = ranking.bradley_terry(x, y, pairs=40_000)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(4), d.T @ p / len(d) - 1e-3 * w)
    assert model.weights @ w / np.linalg.norm(model.weights) / np.linalg.norm(w) > 0.99 and 0.9 < np.linalg.norm(model.weights) / np.linalg.norm(w) < 1.1
    strength = z @ model.weights
    assert model.cut == pytest.approx(np.quantile(strength, 70 / 120))
    scores = model.score(x)
    assert (np.argsort(scores, kind="stable") == np.argsort(strength, kind="stable")).all()
    assert ((scores >= ranking.THRESHOLD) == (strength >= model.cut)).mean() == 1 and (scores >= ranking.THRESHOLD).sum() == 50


def test_ranking_scores_whole_texts(spark):
    """Each row's score is the model's for its own whole text, whatever batch it stands in."""
    rng = np.random.default_rng(5)
    texts = [*ODD, "z" * 300_000 + " tail?"]
    x = ranking.features(texts * 4)
    model = ranking.bradley_terry(x, rng.integers(0, 2, len(x)), pairs=500, steps=20)
    got = {r.doc_id: r.score for r in ranking.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    assert len(got) == len(texts) and all(got[i] == pytest.approx(float(model.score(ranking.features([t]))[0])) for i, t in enumerate(texts))
