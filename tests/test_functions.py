"""Functions and operators on rows whose results are known."""

import math

import pytest
from pyspark.sql import functions as F

from proofline.functions import expressions as E
from proofline.functions import numbers as N
from proofline.functions import text as X
from proofline.functions import units as U
from proofline.operators import acceptance, coverage, evidence, gates, graph, precedence, report, series


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_units(spark):
    rows = [(1.0, u) for u in ("m^2", "m³/s", "degC", "°C", "ppm", "kg/s per ACH", "furlong", "MA", "1/(kg/kg)", "kg/(s.person)", "degC/s", "min", "Min", "h*kPa")]
    got = {r.unit: (r.si_value, r.si_unit) for r in U.to_si(spark.createDataFrame(rows, "value double, unit string")).collect()}
    assert got["m^2"] == (1.0, "m2") and got["m³/s"] == (1.0, "m3/s") and got["°C"] == got["degC"] == (274.15, "K") and got["MA"] == (1e-3, "A")
    assert got["kg/s per ACH"][1] == "kg" and math.isclose(got["kg/s per ACH"][0], 3600) and got["furlong"] == (None, None) and got["1/(kg/kg)"] == (1.0, "1")
    assert got["kg/(s.person)"] == (1.0, "kg/s") and got["degC/s"] == (None, None) and got["min"] == (60.0, "s") and got["Min"] == (None, None) and got["h*kPa"] == (None, None)


def test_text(spark):
    assert one(spark, X.make_id(F.lit("part"), F.lit("Tank é 1"))) == "tank_e_1" and one(spark, X.make_id(F.lit("part"), F.lit("state"))) == "part_state" and one(spark, X.make_id(F.lit("p"), F.lit("--"))) is None
    assert one(spark, X.quoted_name(F.lit("it's"))) == r"'it\'s'" and one(spark, X.iso_date(F.lit("on 3 Sept. 2026"))) == "2026-09-03" and one(spark, X.iso_date(F.lit("31 Feb 2026"))) is None
    assert one(spark, X.mentions(F.lit("see AB-12"), F.lit("AB-1"))) is False and one(spark, X.mentions(F.lit("see ab-1."), F.lit("AB-1"))) is True
    assert one(spark, X.clock_seconds(F.lit("24:00"))) == 86400 and one(spark, X.clock_seconds(F.lit("90.5"))) == 90.5 and one(spark, X.clock_seconds(F.lit("x"))) is None
    assert one(spark, N.parse_value(F.lit("1,234.5 ± 0.2"))) == [1234.5] and one(spark, N.parse_value(F.lit("−3, 4"))) == [-3.0, 4.0]
    assert one(spark, X.redact(F.lit("key sk-abcdefgh12"))) == "key sk-***" and one(spark, X.shortest_number(F.lit(1e-5))) == "1e-05" and one(spark, X.package_name(F.lit("2 tank demo"))) == "P2TankDemo"
    assert one(spark, X.keyword_role(F.lit("Design Review minutes"))) == "review_decision" and one(spark, X.keyword_role(F.lit("my model"), F.lit("modelica"))) == "legacy_model"
    assert one(spark, X.mail_date(F.lit("Mon, 02 Mar 2026 10:00:00 +0200"))).hour == 8 and one(spark, X.mail_date(F.lit("Sunday, March 1, 2026 09:00"))).day == 1 and one(spark, X.mail_date(F.lit("?"))) is None
    assert one(spark, N.close_lists(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0 + 1e-10)))) is True and one(spark, N.states_number(F.lit("after 12.5 s"), F.lit(12.5))) is True


def test_conditions(spark):
    tree = E.parse("not a and (b > 2 or in_state(idle)) == true")
    assert E.names(tree) == ["a", "b"] and E.calls(tree) == [("in_state", "idle")] and E.show(tree) == "not a and (b > 2 or in_state(idle)) == true"
    assert E.show(E.parse("(a or b) and c")) == "(a or b) and c" and E.show(E.parse("a or (b and c)")) == "a or b and c" and E.show(E.rename(E.parse("a < 1.5"), {"a": "z"})) == "z < 1.5"
    for bad in ("", "a <", "a < b < c", "f(x)", "a b", "in_state(1)", "a $ b", "and", "(a"):
        with pytest.raises(E.ConditionError):
            E.parse(bad)
    assert E.parse_action("start_timer(t1)") == ("start_timer", "t1") and E.parse_action("save_history") == ("save_history", None)
    for bad in ("start_timer", "save_history(x)", "jump"):
        with pytest.raises(E.ConditionError):
            E.parse_action(bad)
    df = spark.createDataFrame([(True, 3.0, 1), (False, 1.0, 2), (False, 3.0, 2)], "a boolean, b double, s int")
    got = [r.x for r in df.select(E.compile_(E.parse("not a and b >= 2"), F.col).alias("x")).collect()]
    assert got == [False, False, True]


def test_precedence(spark):
    rows = [
        ("single", 1.0, 3, None, None, 1), ("status", 1.0, 1, None, None, 1), ("status", 2.0, 5, None, "effective", 2), ("live", 1.0, 1, None, "superseded", 1), ("live", 2.0, 5, None, None, 2),
        ("ladder", 1.0, 2, None, None, 1), ("ladder", 2.0, 1, None, None, 2), ("later", 1.0, 1, "2026-01-01", None, 1), ("later", 2.0, 1, "2026-02-01", None, 2), ("tie", 1.0, 1, "2026-01-01", None, 2), ("tie", 2.0, 1, None, None, 1),
    ]
    found = precedence.values(spark.createDataFrame(rows, "key string, value double, rank int, date string, stated string, ord int"))
    got = {r.key: (r.winner, r.rule) for r in precedence.choose(found).collect()}
    assert got == {"single": (1.0, "single"), "status": (2.0, "status"), "live": (2.0, "status"), "ladder": (2.0, "ladder"), "later": (2.0, "later"), "tie": (2.0, "tie")}
    near = spark.createDataFrame([("k", 1.0, 1), ("k", 1 + 9e-10, 2), ("k", 1 + 1.8e-9, 3)], "k string, v double, o int")
    assert sorted((r.head, r.members) for r in precedence.clusters(near, "k", "v", "o").collect()) == [(1.0, 2), (1 + 1.8e-9, 1)]


def test_graph(spark):
    links = spark.createDataFrame([("A-1", "x", 1), ("x", "B-2", 2), ("x", "y", 3), ("B-2", "z", 4)], "a string, b string, ord int")
    got = {r.node: r.root for r in graph.components_with_veto(links, "^[A-Z]-[0-9]$").collect()}
    assert got == {"A-1": "A-1", "x": "A-1", "y": "A-1", "B-2": "B-2", "z": "B-2"}
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    assert dict(graph.components(spark.createDataFrame(chain, "a long, b long")).collect()) == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    placed = graph.columns(dag, nodes)
    assert {r.node: r.column for r in placed.collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert {(r.node, r.row) for r in graph.layout(dag, nodes).collect()} == {("a", 0), ("b", 0), ("d", 1), ("c", 0)}


def test_series(spark):
    trace = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 5.0, 2.0), ("s", 2, 5.0, 9.0), ("s", 3, 10.0, 4.0)], "series string, ord long, t double, value double")
    asked = spark.createDataFrame([("s", t) for t in (-1.0, 2.5, 5.0, 7.5, 99.0)], "series string, t double")
    for width in (1.0, 4.0, 1000.0):
        assert {r.t: r.value for r in series.hold(trace, asked, width).collect()} == {-1.0: 1.0, 2.5: 1.0, 5.0: 9.0, 7.5: 9.0, 99.0: 4.0}
        assert {r.t: r.value for r in series.interpolate(trace, asked, width).collect()} == {-1.0: 1.0, 2.5: 1.5, 5.0: 9.0, 7.5: 6.5, 99.0: 4.0}
        assert [(r.t, r.value, r.n) for r in series.changes(trace, "value", width).orderBy("n").collect()] == [(5.0, 2.0, 1), (5.0, 9.0, 2), (10.0, 4.0, 3)]
    flat = spark.createDataFrame([("z", 0.0, 0.0, 0.5), ("f", 0.0, 7.0, 7.05)], "series string, t double, want double, got double")
    assert {r.series: (r.limit, r.status) for r in series.continuous_error(flat, 0.02).collect()} == {"z": (0.02, "FAIL"), "f": (0.14, "PASS")}
    run = trace.withColumn("level", F.col("value"))
    judge = lambda *a, **k: acceptance.evaluate(run, *a, names={"level": "level"}, **k).first()
    assert judge("always", "level > 0").status == "PASS" and judge("always", "level < 9").at == 5.0 and judge("eventually", "level == 9").status == "PASS"
    assert judge("at", "level == 9", start=5.0).status == "PASS" and judge("always", "level > 0", end=50.0).status == "NOT CHECKED" and judge("always", "nope > 0").reason
    assert judge("always", "level == 9", start=5.0, end=10.0).samples == 1 and judge("always", "level > 0", complete=False).status == "NOT CHECKED" and judge("eventually", "level > 0", start=11.0).status == "NOT CHECKED"


def test_coverage(spark):
    rows = [("p", "a", ["x"]), ("p", "b", ["x", "y"]), ("p", "c", ["q"])]
    df = spark.createDataFrame(rows, "category string, id string, keys array<string>")
    assert {r.percent for r in coverage.by_id(df, df).collect()} == {100.0}
    other = spark.createDataFrame([("p", "k", ["x"]), ("p", "l", ["y"]), ("p", "c", ["z"])], df.schema)
    assert {(r.reference, r.produced, r.by) for r in coverage.greedy_pairs(df, other).collect()} == {("c", "c", "id"), ("a", "k", "alias"), ("b", "l", "alias")}
    empty = df.limit(0)
    assert {(r.reference, r.percent) for r in coverage.by_id(empty, df).collect()} == {(0, 100.0)}


def test_rest(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\nc\n \nd"), (2, None), (3, "x" * 950 + "\ny")], "k int, text string")
    assert [(r.k, r.first_line, r.last_line) for r in evidence.paragraphs(docs, "k").orderBy("k", "paragraph").collect()] == [(1, 1, 1), (1, 3, 4), (1, 6, 6), (3, 1, 2)]
    assert [(r.k, r.first_line, r.last_line) for r in evidence.blocks(docs, "k").orderBy("k", "block").collect()] == [(1, 1, 6), (3, 1, 1), (3, 2, 2)]
    split = evidence.blocks(spark.createDataFrame([(1, "# a\nb\n# c")], "k int, text string"), "k", starts_block="^#")
    assert split.count() == 2
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["noise", "[1] bad", "  more", "[2] worse"])], "source string, n int, line string")
    assert sorted(r.text for r in report.message_blocks(lines, r"^\[").collect()) == ["[1] bad\n  more", "[2] worse"]
    gate = gates.honesty([("part", spark.createDataFrame([(1, None, True), (2, None, False)], "id int, parent int, traced boolean")), ("port", spark.createDataFrame([(10, 1, True), (20, 2, True), (30, 1, False)], "id int, parent int, traced boolean"))])
    assert sorted(r.id for r in gate[0].collect()) == ["1", "10"] and gate[1].count() == 3
    same = series.early_stop(spark.createDataFrame([("s", 10.0)], "series string, t double"), spark.createDataFrame([("s", 7.0)], "series string, t double"), 2.0)
    assert same.count() == 1


def test_equal_texts_are_read_once():
    import pandas as pd

    from proofline.functions import expressions

    read = []

    def one(text, to):
        read.append(text)
        return expressions.show(expressions.rename(expressions.parse(text), dict(to)))

    texts, maps = ["a > 1", "a > 1", "a >", "a > 1", None] * 50, [{"a": "p"}, {"a": "q"}, {}, {"a": "p"}, {}] * 50
    assert expressions._tried(one, pd.Series(texts), pd.Series(maps)) == ["p > 1", "q > 1", None, "p > 1", None] * 50
    assert len(read) == 4
