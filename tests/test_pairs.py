"""Joins on keys that many rows share: counted before rows meet, so that no join makes rows by the square of a key's rows."""

import random

from proofline.operators import assembly, entities, matching, model, skew
from proofline.plans import QUERIES


def rows_of_joins(df) -> int:
    """The most rows that any join of a result makes, from the metrics of the plan as it ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name.endswith("JoinExec") and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_bundle_match(spark):
    docs = [(n, f"F{n % 2}.pdf", "Tag-7" if n % 4 == 1 else "other") for n in range(200)] + [(900, "one.pdf", None), (901, None, "TAG-7"), (902, "one.pdf", None), (902, "two.pdf", None), (903, "gone", "gone")]
    files = [(n, "f0.PDF", "a report") for n in range(200)] + [(500, "One.pdf", "x"), (500, "one.PDF", "x"), (501, "two.pdf", "x"), (502, "y", "on tag-7 tag-7"), (None, "f1.pdf", "x")]
    found = model.bundle_match(spark.createDataFrame(docs, "id long, file_name string, tag string"), spark.createDataFrame(files, "source_id long, basename string, title string"))
    want = {n: 502 if n % 4 == 1 else None for n in range(200)} | {900: 500, 901: 502, 902: None, 903: None}
    assert {r.id: r.source_id for r in found.collect()} == want
    assert rows_of_joins(found) < 1000  # 200 x 200 documents and files of one name before


def test_measured_part(spark):
    inputs = [(n, 0, "reads site 1 daily") for n in range(200)] + [(500, 0, "site 2 and site 3"), (501, 1, "site 2"), (502, 0, "site 3"), (503, 0, "site 4"), (504, 0, "site 4"), (504, 0, "site 3"), (505, 0, "site 5, site 6")]
    parts = [(n, 0, "site 1") for n in range(200)] + [(300, 0, "site 2"), (301, 0, "site 3"), (301, 0, "site 3"), (302, 1, "site 3"), (303, 0, "site 5"), (303, 0, "site 6")]
    found = entities.measured_part(spark.createDataFrame(inputs, "input long, kind int, text string"), spark.createDataFrame(parts, "part long, kind int, name string"))
    want = {n: ("question", None) for n in range(200)} | {500: ("question", None), 501: ("missing", None), 502: ("link", 301), 503: ("missing", None), 504: ("link", 301), 505: ("link", 303)}
    assert {r.input: (r.outcome, r.part) for r in found.collect()} == want
    assert rows_of_joins(found) < 1000  # 200 x 200 inputs and parts of one name before


def test_choose_ports(spark):
    columns = [(n, 0, ["a", "b", "a", None], "K") for n in range(200)] + [(500, 0, ["c"], "K"), (501, 0, ["c", "d"], "K"), (502, 1, ["a"], "K"), (503, 1, None, "m"), (504, 2, ["z"], None), (505, None, ["a"], None)]
    ports = [(n, 0, ["b", "a"], "in", "fluid", "K", "v") for n in range(200)] + [(300, 0, ["c", "x"], "in", "signal_bool", "K", "v"), (301, 0, ["d", "c", None], "in", "fluid", "m", "v"), (302, 1, ["q"], "out", "signal_real", "K", "w"), (303, 2, ["z"], "in", "fluid", "K", None)]
    found = matching.choose_ports(
        spark.createDataFrame(columns, "column int, part int, rest array<string>, si_unit string"), spark.createDataFrame(ports, "port int, part int, tokens array<string>, direction string, domain string, si_unit string, variable string")
    )
    want = {n: (None, None, "ports fit equally") for n in range(200)} | {500: (None, None, "ports fit equally"), 501: (None, None, "units differ"), 502: (302, "continuous", None), 503: (None, None, "units differ"), 504: (None, None, "no variable"), 505: (None, None, "no port fits")}
    assert {r.column: (r.port, r.kind, r.reason) for r in found.collect()} == want
    assert rows_of_joins(found) < 1000  # 200 x 200 columns and ports of one set of tokens before


def test_connections_meet_one_table_an_end(spark, monkeypatch):
    role = "array<struct<role:string,direction:string,domain:string>>"
    parts = [("v1", False, "V1", [("out", "out", "fluid"), ("level", "out", "signal_real")]), ("v2", False, None, [("in", "in", "fluid"), ("command", "in", "signal_real")]), ("c1", True, "C", None)]
    fragments = [(1, 10, "K-1", "V 1", "out", "v2", None, "water", None), (2, 11, None, "V-1", None, "C1", None, None, "lvl"), (3, 12, None, "C1", None, "V2", None, "wire", "!"), (4, 13, None, "V1", None, "gone", None, None, None), (5, 14, "K 1", "v1", "level", "V2", None, None, None)]
    written, write = [], assembly.materialise
    monkeypatch.setattr(assembly, "materialise", lambda df, what: written.append(df) or write(df, what))
    every = spark.createDataFrame(parts, f"part string, dynamic boolean, alias string, ports {role}")
    found, problems = assembly.resolve_connections(
        spark.createDataFrame(fragments, "ord int, chunk int, tag string, from_tag string, from_role string, to_tag string, to_role string, medium string, signal string"), every.select(every.part.alias("key"), "part"), every
    )
    assert {(*r[:4], *r.traces) for r in found.collect()} == {
        ("k_1", "v1_out", "v2_in", "water", 10), ("c1_v2_to_v2_command", "c1_v2", "v2_command", "wire", 12), ("v1_level_to_c1_v1", "v1_level", "c1_v1", None, 11), ("v1_level_to_v2_command", "v1_level", "v2_command", None, 14)
    }
    assert {(r.ord, r.reason) for r in problems.collect()} == {(4, "not a known part")}
    node, joins = written[0]._jdf.queryExecution().optimizedPlan(), 0
    while node.children().size():
        joins, node = joins + (node.getClass().getSimpleName() == "Join"), node.children().apply(0)
    assert joins == 2  # four before: names and parts apart
    assert not any("array" in t or c.startswith("__") for c, t in written[0].dtypes)  # ports and keys are not written


def test_covered_ports_are_shuffled_once_a_step(spark, sf, monkeypatch):
    """Ports go by id once and by their keys once, whatever is repeated or missing; the query groups its lines once for both sides."""
    rng = random.Random(4)

    def ports(n):
        return [(rng.choice([None, *range(60)]), rng.choice([None, *range(5)]), rng.choice([None, "in", "out"])) for _ in range(n)]

    part_map, reference, produced = [(0, 10), (1, 11), (1, 12), (2, 2), (3, 2), (None, 4)], ports(150), [(i, p if p is None or p == 2 else p + 10, r) for i, p, r in ports(130)]
    mapped = [(i, q, r) for i, p, r in reference for p0, q in part_map if p is not None and p == p0]
    want = [(i, i, "id") for i, p, _ in mapped for j, q, _ in produced if i is not None and (i, p) == (j, q)]
    met = {i for i, _, _ in want}
    left, right = ([row for row in side if row[0] not in met] for side in (mapped, produced))
    for key in {row[1:] for row in left if None not in row[1:]}:
        a, b = (sorted((row[0] for row in side if row[1:] == key), key=lambda i: (i is not None, i)) for side in (left, right))
        want += [(*pair, "alias") for pair in zip(a, b, strict=False)]
    assert {by for _, _, by in want} == {"id", "alias"} and len(set(want)) < len(want)
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        sides = [spark.createDataFrame(rows, "id int, part int, role string") for rows in (reference, produced)]
        maps = spark.createDataFrame(part_map, "reference int, produced int")
        assert sorted(map(str, map(tuple, matching.covered_ports(maps, *sides).collect()))) == sorted(map(str, want))
        found = matching.covered_ports(maps, *sides, 280)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4  # two of them meet the map
        monkeypatch.setattr(skew, "DEALT_ROWS", 20)
        found = matching.covered_ports(maps, *sides, 280)
        assert found._jdf.queryExecution().executedPlan().toString().count(", 14), REPARTITION_BY_NUM") == 2
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        plan = QUERIES["covered_ports"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- Exchange hashpartitioning(l_orderkey") == 1 and "ReusedExchange" in plan
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
