"""Joins with hot keys give what plain joins give."""

import random
import re

import pytest

from proofline.operators import graph, skew


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_one(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5 if i % 3 else 1) for i in range(300)], "id long, k int")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (3, None), (9, "z")], "k int, v string")
    want = sorted(map(str, rows.join(table, "k", how).collect()))
    assert sorted(map(str, skew.join_one(rows, table, "k", how).collect())) == want
    monkeypatch.setattr(skew, "LEAST", 30)
    assert sorted(map(str, skew.join_one(rows, table, "k", how).collect())) == want
    assert skew.join_one(rows.limit(0), table, "k", how).count() == 0


def test_drivers_are_dealt_by_size(spark, monkeypatch):
    """Links come to tasks of a bounded number of rows, in one shuffle of all links; a hot input and links without one do not."""
    rng = random.Random(3)
    links = [(n % 60, rng.randrange(6), rng.randrange(3), rng.randrange(4)) for n in range(1500)]
    links += [(77, rng.randrange(200), rng.randrange(3), rng.randrange(50)) for _ in range(900)] + [(None, n % 3, 1, n) for n in range(900)]
    links += [(90, None, 1, 5), (90, 4, 2, 6), (91, None, 1, 5), (91, 4, 1, 6), (92, 1, 1, None), (92, 2, 1, 7), (93, 8, 2, 1), (93, 8, 1, 1)]
    want = {}
    for i in {link[0] for link in links}:
        evidence = {}
        for _, d, rank, source in (link for link in links if link[0] == i):
            best, sources = evidence.get(d, (9, set()))
            evidence[d] = min(best, rank), sources | ({source} - {None})
        top = min((rank, -len(sources)) for rank, sources in evidence.values())
        first = [d for d, (rank, sources) in evidence.items() if (rank, -len(sources)) == top]
        want[i] = (first[0] if len(first) == 1 else None, len(evidence))
    df = spark.createDataFrame(links, "input int, driver int, rank int, source int")
    assert {r.input: (r.driver, r.n_drivers) for r in graph.single_drivers(df).collect()} == want
    monkeypatch.setattr(skew, "DEALT_ROWS", 100)
    monkeypatch.setattr(graph, "HOT_INPUT", 500)
    found = graph.single_drivers(df)
    assert {r.input: (r.driver, r.n_drivers) for r in found.collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(input#\d+, 34\), REPARTITION_BY_NUM", plan)  # 3,308 links
