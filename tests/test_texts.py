"""Dates, headers, fixes of sources, page cuts and press times, on forms written out."""

import pytest
from pyspark.sql import functions as F

from proofline.functions import text as X
from proofline.operators import render, schedule
from proofline.sources.readers import starts_part


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(column).collect()]


def test_dates(spark):
    cases = {
        "due 2026-01-15.": "2026-01-15", "3 Sept 2026": "2026-09-03", "3-September-2026": "2026-09-03", "May 5, 2021": "2021-05-05", "Oct. 12 1999": "1999-10-12", "31 Feb 2020 or 1 Mar 2020": "2020-03-01",
        "issue 12 2021-05-06": "2021-05-06", "x2020-01-01": None, "no date": None, "12 Room 2020": None, "9999-99-99, 2001-02-03": "2001-02-03",
    }
    assert values(spark, X.iso_date(F.col("t")), cases) == list(cases.values())


def test_headers(spark):
    cases = {
        "**Document No:** AB-12/C\nRev. B2.\nDate: 3 May 2020\nStatus: For review\n": ("AB-12/C", "B2", "2020-05-03", "For review"),
        "Supplier document number\nX1-200\nRevision\nC\nDate\n2020-01-02\nDocument status\nIssued": ("X1-200", "C", "2020-01-02", "Issued"),
        "documents are here. Document ID # Q-1": ("Q-1", None, None, None),
        "Reviewed 2019-04-05, no labels": (None, None, "2019-04-05", None),
        "Status quo\nDocument: lower-case": (None, None, None, "quo"),
        "": (None, None, None, None),
    }
    assert [tuple(r) for r in values(spark, X.header(F.col("t")), cases)] == list(cases.values())


def fixed(spark, fix, text, messages):
    [row] = spark.createDataFrame([(text, messages)], "t string, m string").select(fix(F.col("t"), F.col("m"))).collect()
    return row[0]


def test_import_fixes(spark):
    text = "package P\n  partial model A\n    Real x;\n  end A;\n  block B \"b\"\n  end B;\nend P;"
    found = "[f.mo:3] Error: Class SI.Length not found in scope P.A.\nError: Class Constants.pi not found in scope P.B.\nError: Class Own.x not found in scope A\nError: Class SI.Mass not found in scope A"
    want = "package P\n  partial model A\n    import SI = Modelica.Units.SI;\n    Real x;\n  end A;\n  block B \"b\"\n    import Constants = Modelica.Constants;\n  end B;\nend P;"
    assert fixed(spark, render.import_fixes, text, found) == want
    assert fixed(spark, render.import_fixes, want, found) == want
    assert fixed(spark, render.import_fixes, text, "nothing") == text and fixed(spark, render.import_fixes, None, found) is None and fixed(spark, render.import_fixes, text, None) == text


def test_reserved_names(spark):
    text = 'model M\n  parameter Real final(unit = "1");\n  Pump end "x";\n  Real ok(start = 1);\n  final Real y = end.port + a.final + final.z;\nend M;'
    want = 'model M\n  parameter Real final_(unit = "1");\n  Pump end_ "x";\n  Real ok(start = 1);\n  final Real y = end_.port + a.final + final_.z;\nend M;'
    assert fixed(spark, render.reserved_name_fixes, text, "Error: No viable alternative near token: final") == want
    assert fixed(spark, render.reserved_name_fixes, text, "another message") == text and fixed(spark, render.reserved_name_fixes, text, None) == text


def test_unit_fixes_take_every_message(spark):
    text = 'Real a(unit = "m^2"); Real b(unit = "m^3"); Real c(unit = "kg m**2"); Real d(unit = "m³"); Real e(unit = "K");'
    found = "".join(f"Error: Invalid unit expression '{u}'\n" for u in ("m^2", "m^3", "kg m**2", "m³"))
    assert fixed(spark, render.unit_fixes, text, found) == 'Real a(unit = "m2"); Real b(unit = "m3"); Real c(unit = "kgm2"); Real d(unit = "m3"); Real e(unit = "K");'
    assert fixed(spark, render.unit_fixes, text, None) == text


@pytest.mark.parametrize(("line", "starts"), [("1. Scope", True), ("2.3. Pumps and so on", True), ("2.3 Pumps", False), ("1. lower", False), ("AB-12 - a pump", True), ("AB-12: a pump", False), ("AB-12 : a pump", True), ("ab-1 - x", False), ("• item", True), ("- item", True), ("-item", False), (" - item", False), ("Plain text", False), ("", False), ("A-1 -", False), ("1.", False)])
def test_parts_of_pages(line, starts):
    assert starts_part(line) is starts


def test_press_times(spark):
    rows = [("a", "Press START at 20 s, then restart at 30 s; Start  at 5.5 s", {}), ("b", "Time (s)\n7\nSTART\n 9 \n start \n11\nother", {}), ("c", "7\nSTART", {}), ("d", "t: 12 | button: start", {"Time [s]": " 12 ", "Button": "Start"}), ("e", "start 1 2", {"time [s]": "1", "End time (s)": "2", "b": "START"}), ("f", "starter at 3 s", {})]
    texts = spark.createDataFrame(rows, "source string, text string, fields map<string,string>")
    names = spark.createDataFrame([("PB", "START")], "control string, name string")
    assert {(r.source, tuple(r.times)) for r in schedule.press_times(texts, names, "fields").collect()} == {("a", (5.5, 20.0)), ("b", (7.0, 9.0)), ("d", (12.0,))}
    assert {(r.source, tuple(r.times)) for r in schedule.press_times(texts, names).collect()} == {("a", (5.5, 20.0)), ("b", (7.0, 9.0))}


def test_press_times_of_words_are_read_once(spark, monkeypatch):
    rows = [("a", "start at 1 S AT 2 s; STOP\tat\n3.5s, xstart at 4 s, start at 5 sec, start9 at 6 s", {}), ("b", "T [s]\n time [ S ]\n1\nSTART\r\n2\n\tstop 1\t\n3", {}), ("c", "\u212atop at 4 s, Start at 8 s é", {}), ("d", "start | 5", {"time (s)": "5", "x": "START", "y": "stop"}), ("e", None, {"time (s)": "5", "x": "start"})]
    texts = spark.createDataFrame(rows, "source string, text string, fields map<string,string>")
    names = [("A", "START"), ("A2", "start"), ("B", "stop"), ("K", "ktop"), ("S", "s"), ("T", "at"), ("W", "stop 1"), ("N", None)]
    tried, pairs = [], schedule._tried
    monkeypatch.setattr(schedule, "_tried", lambda t, c, f: tried.append(({r.source for r in t.collect()}, {r.name for r in c.collect()})) or pairs(t, c, f))
    for fields in (None, "fields"):
        controls = spark.createDataFrame(names, "control string, name string")
        every = pairs(texts, controls, fields).groupBy("control", "source").agg(F.array_sort(F.collect_set("t")).alias("times"))
        got = schedule.press_times(texts, controls, fields).collect()
        assert sorted(map(str, got)) == sorted(map(str, every.collect())) and len(got) >= 6
    assert tried == [({"c"}, {n for _, n in names}), ({"a", "b", "d"}, {"s", "at", "stop 1"})] * 2  # all names were tried on all texts before
