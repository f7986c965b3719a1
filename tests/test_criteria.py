"""Criteria evaluated together against the same criteria one by one."""

import random

from pyspark.sql import functions as F

from proofline.operators import acceptance

CONDITIONS = [
    "a > 1", "a >= 1 and not b", "a == 2 or b", "not (a < 1 or in_state(on))", "in_state(off) and a <= 2", "a != 1", "true", "false or a > 0.5", "a > 1 and b and a < 3", "in_state(gone)", "timer_expired(t)", "a >", "c > 1", "a $ 1", "not not b", "",
]


def test_together_and_one_by_one(spark):
    rng = random.Random(7)
    rows = [(s, n, float(n // 2), rng.choice([0.0, 1.0, 2.0, 3.0, None]), rng.choice([0.0, 1.0]), rng.choice([1.0, 2.0])) for s in ("x", "y") for n in range(12)]
    run = spark.createDataFrame(rows, "series string, ord long, t double, a double, b double, s double")
    criteria, want = [], {}
    for n, condition in enumerate(CONDITIONS):
        for mode in ("always", "eventually", "at"):
            start, end = rng.choice([(None, None), (1.0, 4.0), (2.5, None), (None, 3.0), (9.0, None), (1.0, 20.0)])
            criteria += [(f"{n} {mode} {s}", s, mode, condition, start, end) for s in ("x", "y")]
            one = acceptance.evaluate(run, mode, condition, {"a": "a", "b": "b"}, start, end, ("b",), {"on": ("s", 1), "off": ("s", 2)}) if condition else None
            for r in one.collect() if one else ():
                want[f"{n} {mode} {r.series}"] = (r.status, r.samples, r["at"], r.reason is None)
    frame = spark.createDataFrame([*criteria, ("lost", "z", "at", "a > 1", None, None)], "id string, series string, mode string, condition string, start double, end double")
    packed = run.select("series", "ord", "t", F.create_map(F.lit("a"), "a", F.lit("b"), "b", F.lit("s"), "s").alias("values"))
    got = {r.id: (r.status, r.samples, r["at"], r.reason is None) for r in acceptance.evaluate_all(packed, frame, ("b",), {"on": ("s", 1), "off": ("s", 2)}).collect()}
    assert all(got.pop(f"{len(CONDITIONS) - 1} {m} {s}")[0] == "NOT CHECKED" for m in ("always", "eventually", "at") for s in "xy")
    assert got == want


def _run_and_criteria(spark, modes=("always", "eventually", "at")):
    rows = [(s, n, float(n // 2), float(n % 4) if n % 5 else None, float(n % 2 + 1)) for s in ("x", "y") for n in range(12)]
    run = spark.createDataFrame(rows, "series string, ord long, t double, a double, s double").select("series", "ord", "t", F.create_map(F.lit("a"), "a", F.lit("s"), "s").alias("values"))
    criteria = [(f"{n} {m} {s}", s, m, c, None, e) for n, c in enumerate([*CONDITIONS, None]) for m in modes for s in "xy" for e in (None, 4.0)]
    return run, spark.createDataFrame([(f"{i} {e}", s, m, c, b, e) for i, s, m, c, b, e in criteria], "id string, series string, mode string, condition string, start double, end double")


def test_few_conditions_as_columns_and_many_by_a_fold(spark, monkeypatch):
    run, criteria = _run_and_criteria(spark)
    states = {"on": ("s", 1), "off": ("s", 2)}
    few = acceptance.evaluate_all(run, criteria, states=states)
    monkeypatch.setattr(acceptance, "COMPILED", 0)
    many = acceptance.evaluate_all(run, criteria, states=states)
    assert "lambdafunction" in many._jdf.queryExecution().toString()
    assert "lambdafunction" not in few._jdf.queryExecution().toString()
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_many_windows_are_never_broadcast(spark, monkeypatch):
    """Spark guesses the size from a file that compresses well; in memory a million windows are many times that."""
    run, criteria = _run_and_criteria(spark, ("at",))
    want = sorted(map(repr, acceptance.evaluate_all(run, criteria).collect()))
    monkeypatch.setattr(acceptance, "BROADCAST_ROWS", 0)
    many = acceptance.evaluate_all(run, criteria)
    assert "SortMergeJoin [series" in many._jdf.queryExecution().toString()
    assert sorted(map(repr, many.collect())) == want
