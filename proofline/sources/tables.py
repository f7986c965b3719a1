"""Time tables, evidence and model files, recorded replies, catalogues and settings as DataFrames; and their sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.numbers import finite

TRACE = "struct<source_id:string,locator:string,quote:string>"
# Fixed schemas of the model's tables.
SCHEMAS = {
    "sources": "source_id string, path string, format string, status string, reason string, title string, role string, revision string, date string, reliability string, document string",
    "chunks": "source_id string, pos int, chunk_id string, locator string, text string, kind string, role string, fields array<struct<k:string,v:string>>",
    "parts": f"id string, kind string, name string, tags array<string>, attributes array<struct<k:string,v:string>>, confidence double, assumption_ids array<string>, trace array<{TRACE}>",
    "ports": f"id string, part_id string, role string, direction string, domain string, unit string, assumption_ids array<string>, trace array<{TRACE}>",
    "connections": f"id string, from_port string, to_port string, medium_or_signal string, assumption_ids array<string>, trace array<{TRACE}>",
    "parameters": f"id string, owner string, name string, value array<double>, is_list boolean, unit string, status string, authority string, assumption_ids array<string>, trace array<{TRACE}>",
    "requirements": f"id string, text string, status string, superseded_by string, satisfied_by array<string>, trace array<{TRACE}>",
    "criteria": f"id string, tags array<string>, text string, mode string, condition string, start_s double, end_s double, reason string, trace array<{TRACE}>",
    "machines": f"id string, owner string, initial string, assumption_ids array<string>, trace array<{TRACE}>",
    "states": "machine string, ord int, state string, name string, tags array<string>, actions array<string>, outputs array<struct<port:string,value:string>>",
    "transitions": "machine string, id string, from_state string, to_state string, trigger string, guard string, actions array<string>, priority int",
    "events": "machine string, event string, port string, edge string",
    "timers": "machine string, timer string, duration string",
    "regions": "machine string, id string, name string, states array<string>, initial string",
    "assumptions": f"id string, text string, basis string, affects array<string>, confidence double, trace array<{TRACE}>",
    "questions": "id string, text string, options array<string>, default_if_unanswered string, affects array<string>, answer string",
    "conflicts": "id string, subject string, field string, resolution string, rationale string",
    "candidates": "id string, value string, source_id string, rank int, element string",
    "replies": "model string, schema string, response string",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON table with its fixed schema; a row that does not fit stops the read."""
    return spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path)


def unpivoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(column, ord, t, cell) of a time table of text cells; its first column named like time, else the first, is t.

    ord counts the rows of a file in their order; short rows have empty cells.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    time = next((c for c in raw.columns if c.strip().lower() in ("time", "t") or c.strip().lower().startswith("time_")), raw.columns[0])
    rows = raw.withColumn("__ord", F.monotonically_increasing_id()).withColumn("__t", finite(F.col(f"`{time}`")))
    names = [c for c in raw.columns if c != time]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias("cell")) for c in names)))
    return rows.select("__ord", "__t", cells.alias("x")).select("x.column", F.col("__ord").alias("ord"), F.col("__t").alias("t"), "x.cell")


def trace(spark: SparkSession, path: str) -> DataFrame:
    """(series, ord, t, value) of a numeric time table; a cell that is no number stops the read."""
    long = unpivoted(spark, path)
    checked = F.when(F.col("t").isNull() | finite(F.col("cell")).isNull(), F.raise_error(F.concat(F.lit("not a number: "), "cell"))).otherwise(finite(F.col("cell")))
    return long.select(F.col("column").alias("series"), "ord", "t", checked.alias("value"))


def find_reference(sources: DataFrame) -> DataFrame:
    """The one CSV with the role reference_data, or why there is none: path, reason."""
    hit = sources.where("format = 'csv' and role = 'reference_data'").agg(F.count("*").alias("n"), F.min("path").alias("p"))
    return hit.select(F.when(F.col("n") == 1, F.col("p")).alias("path"), F.when(F.col("n") == 0, "no reference data").when(F.col("n") > 1, "several reference files").alias("reason"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded replies by key (the file's name); a file that is not JSON is a miss."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    text = F.decode("content", "utf-8")
    parsed = F.from_json(text, SCHEMAS["replies"])
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("key"), parsed.alias("r")).where("r.schema is not null").select("key", "r.*")


def misses(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests(key) without a recorded reply."""
    return requests.join(recorded.select("key"), "key", "left_anti")


def catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A YAML (or JSON) catalogue of kinds as the dimension tables kinds, kind_ports and kind_params."""
    text = open(path, encoding="utf-8").read()
    try:
        entries = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as why:
            raise RuntimeError("reading YAML needs the yaml package") from why
        entries = yaml.safe_load(text)
    kinds = entries.get("kinds", entries)
    items = kinds.items() if isinstance(kinds, dict) else ((k["kind"], k) for k in kinds)
    rows, ports, params = [], [], []
    for kind, e in items:
        rows.append((kind, e.get("description")))
        roles = [p["role"] for p in e.get("ports", [])]
        if len(set(roles)) != len(roles):
            raise ValueError(f"{kind}: repeated port roles")
        ports += [(kind, p["role"], p.get("direction"), p.get("domain")) for p in e.get("ports", [])]
        defaults = e.get("defaults", {})
        params += [(kind, n, float(defaults[n]) if n in defaults else None) for n in e.get("parameters", [])]
        if set(defaults) - set(e.get("parameters", [])):
            raise ValueError(f"{kind}: a default for no parameter")
    make = spark.createDataFrame
    return {"kinds": make(rows, "kind string, description string"), "kind_ports": make(ports, "kind string, role string, direction string, domain string"), "kind_params": make(params, "kind string, name string, default double")}


def settings(defaults: dict, environ: dict[str, str], file: str | None = None, prefix: str = "PROOFLINE_") -> dict:
    """Typed settings: the environment over a file of NAME=value lines over defaults; a bad value names its variable."""
    told = {}
    if file and os.path.exists(file):
        told = dict(line.strip().split("=", 1) for line in open(file, encoding="utf-8") if "=" in line and not line.lstrip().startswith("#"))
    out = {}
    for name, default in defaults.items():
        key = prefix + name.upper()
        raw = environ.get(key, told.get(key))
        if raw is None:
            out[name] = default
            continue
        try:
            out[name] = {"true": True, "1": True, "false": False, "0": False}[raw.lower()] if isinstance(default, bool) else type(default)(raw)
        except (KeyError, ValueError) as why:
            raise ValueError(f"{key}: {raw!r} is not a {type(default).__name__}") from why
    return out


def load_run(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    """(name, state, reason, text) of the artefacts of a run folder: loaded, missing, or invalid JSON. A name may be a folder of parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = F.decode("content", "utf-8")
    name = F.coalesce(*(F.when(F.col("path").contains(f"/{n}"), n) for n in wanted))
    held = files.withColumn("name", name).where("name is not null and length > 0").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", text.alias("t")))), lambda x: x["t"]), "").alias("text"))
    asked = spark.createDataFrame([(n,) for n in wanted], "name string").join(held, "name", "left")
    bad = F.col("name").endswith(".json") & F.call_function("try_parse_json", F.col("text")).isNull()
    state = F.when(F.col("text").isNull(), "missing").when(bad, "invalid").otherwise("loaded")
    reason = F.when(F.col("text").isNull(), "not written by this run").when(bad, "not valid JSON")
    return asked.select("name", state.alias("state"), reason.alias("reason"), F.when(state == "loaded", F.col("text")).alias("text"))


def artefacts(found: list[tuple[str, str | None, str | None]], wanted: list[str], spark: SparkSession) -> DataFrame:
    """(name, state, reason) of a run's files: loaded, missing or invalid."""
    known = {n: (s, r) for n, s, r in found}
    return spark.createDataFrame([(n, *known.get(n, ("missing", "not written by this run"))) for n in wanted], "name string, state string, reason string")


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """A table as JSON lines in a fixed order: its parts, in the order of their names, are the output."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """A report as lines in a fixed order: its parts, in the order of their names, are the output."""
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a model as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
