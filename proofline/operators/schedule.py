"""Schedules in tables and prose: value columns, start times and the times at which a named control is pressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.numbers import finite

SECONDS = r"\d+(?:\.\d+)?"
NUMBER = rf"^{SECONDS}$"


def table_of(locator: Column) -> Column:
    """`sheet X, row 4` to `sheet X`; null if it is no row."""
    return F.nullif(F.regexp_extract(locator, "^(.*), row [^,]*$", 1), F.lit(""))


def value_column(cells: DataFrame) -> DataFrame:
    """cells(table, header, cell): the one header besides times and indexes whose cells are all numbers; null if none or several."""
    plain = ~F.lower("header").rlike(r"time|start|end|^(no|nr|id|index|row|#)$")
    numeric = cells.where(plain).groupBy("table", "header").agg(F.bool_and(finite(F.col("cell")).isNotNull()).alias("numeric"))
    one = numeric.where("numeric").groupBy("table").agg(F.count("*").alias("n"), F.min("header").alias("h"))
    return cells.select("table").distinct().join(one, "table", "left").select("table", F.when(F.col("n") == 1, F.col("h")).alias("header"))


def press_times(texts: DataFrame, controls: DataFrame, fields: str | None = None) -> DataFrame:
    """texts(source, text) and controls(control, name): the sorted times at which a text says that a control is pressed.

    `name at N s` counts. Where the text has a column of times in seconds, so does the number on the line above one that holds
    nothing but the name. Where texts have `fields` (a map of a row's headers to its cells), the row's one time in seconds
    counts if a cell is the name. The name stands as a whole token; a control may have several names, and matches inside a
    wider one have its time.

    Names that are one word are not tried on texts: what a text states is read once for all of them and then joined by name.
    Other names, and texts that are not ASCII (where lower case may make a letter of another character), are tried in pairs.
    """
    word = F.col("name").rlike(r"\A[A-Za-z][A-Za-z0-9]+\z") & (F.lower("name") != "at")  # no part of `at N s`
    plain = F.col("text").rlike(r"\A[\x00-\x7F]*+\z")
    others = controls.where(~word)
    by_name = _stated(texts.where(plain), fields).join(controls.where(word).select("control", F.lower("name").alias("name")), "name").select("control", "source", "t")
    times = by_name.union(_tried(texts.where(~plain), controls, fields))
    if not others.isEmpty():
        times = times.union(_tried(texts.where(plain), others, fields))
    return times.distinct().groupBy("control", "source").agg(F.array_sort(F.collect_set("t")).alias("times"))


def _stated(texts: DataFrame, fields: str | None) -> DataFrame:
    """What ASCII texts state by the rules of press_times for any name that is one word: source, name (in lower case), t."""
    text, empty = F.col("text"), F.expr("cast(array() as array<struct<name:string,t:string>>)")
    # The text is not put in lower case as a whole. A look-ahead takes no characters, so a word may also stand in what follows one.
    behind = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![a-z0-9])(?=([a-z][a-z0-9]++\s+at\s+{SECONDS}\s*s\b))"), 1)
    said = F.transform(behind, lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z0-9]+", 0).alias("name"), F.regexp_extract(x, rf"({SECONDS})\s*[sS]$", 1).alias("t")))
    rows = texts.withColumn("__lines", F.when(in_seconds(text), F.transform(F.split(F.regexp_replace(text, r"[\t\r]", " "), "\n"), lambda x: F.trim(x))))
    rest = F.greatest(F.size("__lines") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__lines", 2, rest), F.slice("__lines", 1, rest), lambda n, t: F.struct(n.alias("name"), t.alias("t")))
    listed = F.filter(pairs, lambda x: x["t"].rlike(NUMBER))
    stated = F.concat(said, F.coalesce(listed, empty))
    if fields:
        cells = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), F.trim(e["value"]).alias("v")))
        rows = rows.withColumns({"__cells": cells, "__words": F.split(F.lower(text), "[^a-z0-9]+")})
        rows = rows.withColumn("__seconds", F.transform(F.filter("__cells", lambda e: in_seconds(e["k"]) & e["v"].rlike(NUMBER)), lambda e: e["v"]))
        meant = F.transform(F.filter("__cells", lambda e: F.array_contains("__words", F.lower(e["v"]))), lambda e: F.struct(e["v"].alias("name"), F.get("__seconds", F.lit(0)).alias("t")))
        stated = F.concat(stated, F.coalesce(F.when(F.size("__seconds") == 1, meant), empty))
    return rows.select("source", F.explode(stated).alias("x")).select("source", F.lower("x.name").alias("name"), F.col("x.t").cast("double").alias("t")).distinct()


def _tried(texts: DataFrame, controls: DataFrame, fields: str | None) -> DataFrame:
    """The times of press_times, each name tried on each text that mentions it: control, source, t."""
    from proofline.operators.quotes import named

    hits = named(texts, controls)
    name, number = F.lower(F.trim("name")), NUMBER
    none = F.expr("cast(array() as array<string>)")
    escaped = F.regexp_replace(name, r"([^A-Za-z0-9\s])", r"\\$1")
    behind = F.split(F.lower("text"), F.concat(F.lit(r"(?<![a-z0-9])"), escaped, F.lit(r"(?![a-z0-9])")))
    said = F.transform(F.slice(behind, 2, F.size(behind)), lambda x: F.regexp_extract(x, rf"^\s+at\s+({SECONDS})\s*s\b", 1))
    lines = F.transform(F.split(F.lower("text"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    above = F.transform(lines, lambda x, i: F.when((x == name) & (i > 0) & F.get(lines, i - 1).rlike(number), F.get(lines, i - 1)))
    listed = F.when(in_seconds(F.col("text")), above).otherwise(none)
    stated = F.filter(F.concat(said, listed), lambda t: t.isNotNull() & (t != ""))
    if fields:
        cells = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), F.trim(e["value"]).alias("v")))
        seconds = F.transform(F.filter(cells, lambda e: in_seconds(e["k"]) & e["v"].rlike(number)), lambda e: e["v"])
        meant = (F.size(seconds) == 1) & F.exists(cells, lambda e: F.lower(e["v"]) == name)
        stated = F.concat(stated, F.when(F.coalesce(meant, F.lit(False)), seconds).otherwise(none))
    return hits.select("control", "source", F.explode(stated).alias("t")).withColumn("t", F.col("t").cast("double"))


def in_seconds(header: Column) -> Column:
    """Whether a header, or a text with such a header, gives times in seconds."""
    return F.lower(header).rlike(r"time *[(\[] *s *[)\]]")


def agreed_schedules(found: DataFrame) -> DataFrame:
    """Schedules that all sources of a control share: control, sources, times (null where they differ: a question)."""
    return found.groupBy("control").agg(F.count("*").alias("sources"), F.when(F.count_distinct("times") == 1, F.min("times")).alias("times"))


def tables_of_parts(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """parts(part, cited array) to the one table(table, named array) that shares an identifier; null if none or several."""
    a = parts.select("part", F.explode("cited").alias("id")).distinct()
    b = tables.select("table", F.explode("named").alias("id")).distinct()
    hit = a.join(b, "id").groupBy("part").agg(F.count_distinct("table").alias("n"), F.min("table").alias("table"))
    return parts.select("part").join(hit, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("tables"), F.when(F.col("n") == 1, F.col("table")).alias("table"))
