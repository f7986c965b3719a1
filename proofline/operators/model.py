"""Queries on a whole model: paths, bindings, regions, gaps, renames and what refers to what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_parameters(parameters: DataFrame) -> DataFrame:
    """parameters(owner, name, value, status): one per owner and name, effective before verification-only; others are not used."""
    order = F.when(F.col("status") == "effective", 0).when(F.col("status") == "verification_only", 1)
    return parameters.withColumn("o", order).where("o is not null").groupBy("owner", "name").agg(F.min_by("value", "o").alias("value"), F.min_by("status", "o").alias("status"))


def variants(parameters: DataFrame) -> DataFrame:
    """parameters(owner, name, configuration, role): how a value takes part: as built, for verification only, or nominal."""
    kind = F.when(F.lower(F.coalesce("configuration", F.lit(""))).contains("as built") | F.lower(F.coalesce("configuration", F.lit(""))).contains("as-built"), "as_built_only").when(F.col("role").isin("verification_procedure", "reference_data"), "verification_only").otherwise("nominal")
    return parameters.withColumn("variant", kind)


def bindings(parts: DataFrame, kind_params: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each part's catalogue parameters with the stated value, else the default: part, name, value, note (stated, default or missing)."""
    wanted = parts.join(kind_params, "kind").join(parameters.select(F.col("owner").alias("part"), "name", F.col("value").alias("stated")), ["part", "name"], "left")
    return wanted.select("part", "name", F.coalesce("stated", "default").alias("value"), F.when(F.col("stated").isNotNull(), "stated").when(F.col("default").isNotNull(), "default").otherwise("missing").alias("note"))


def domains(ports: DataFrame, kind_ports: DataFrame) -> DataFrame:
    """Domains that parts or kinds use."""
    return ports.select("domain").union(kind_ports.select("domain")).distinct()


def paths(parts: DataFrame, ports: DataFrame, package: str) -> DataFrame:
    """id to qualified path of parts(id) and ports(id, part)."""
    return parts.select("id", F.concat_ws(".", F.lit(package), "id").alias("path")).union(ports.select("id", F.concat_ws(".", F.lit(package), "part", "id")))


def region_faults(states: DataFrame, regions: DataFrame, transitions: DataFrame) -> DataFrame:
    """States outside every region or in several, and transitions that cross regions: machine, item, reason. regions(machine, region, state)."""
    held = regions.groupBy("machine", "state").agg(F.count_distinct("region").alias("n"), F.min("region").alias("region"))
    j = states.join(held, ["machine", "state"], "left")
    wrong = j.where(F.coalesce("n", F.lit(0)) != 1).select("machine", F.col("state").alias("item"), F.when(F.col("n").isNull(), "in no region").otherwise("in several regions").alias("reason"))
    a = held.select("machine", F.col("state").alias("from_state"), F.col("region").alias("ra"))
    b = held.select("machine", F.col("state").alias("to_state"), F.col("region").alias("rb"))
    cross = transitions.join(a, ["machine", "from_state"]).join(b, ["machine", "to_state"]).where("ra <> rb").select("machine", F.col("id").cast("string").alias("item"), F.lit("crosses regions").alias("reason"))
    return wrong.unionAll(cross)


def unknown_operands(operands: DataFrame, known: DataFrame) -> DataFrame:
    """operands(condition, name) that no port or parameter has. known(name)."""
    return operands.join(known.select("name").distinct(), "name", "left_anti")


def against_catalogue(parts: DataFrame, ports: DataFrame, kind_ports: DataFrame) -> DataFrame:
    """Parts of unknown kinds, and ports whose role, direction or domain the kind does not have: id, reason. parts(id, kind), ports(id, part, role, direction, domain)."""
    kinds = kind_ports.select("kind").distinct().withColumn("known", F.lit(True))
    a = parts.join(kinds, "kind", "left").where("known is null").select("id", F.lit("unknown kind").alias("reason"))
    spec = kind_ports.select("kind", "role", F.col("direction").alias("d"), F.col("domain").alias("m"), F.lit(True).alias("has"))
    j = ports.join(parts.select(F.col("id").alias("part"), "kind"), "part").join(kinds, "kind").join(spec, ["kind", "role"], "left")
    why = F.when(F.col("has").isNull(), "unknown role").when(F.col("direction") != F.col("d"), "wrong direction").when(F.col("domain") != F.col("m"), "wrong domain")
    return a.union(j.withColumn("reason", why).where("reason is not null").select("id", "reason"))


def bundle_match(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents(id, file_name, tag) to files(source_id, basename, title): by file name, else by the tag in the title's words; each only if one fits."""
    words = files.select(F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9-]+"))).alias("key"), "source_id")
    by_name = _only_source(documents.select("id", F.lower("file_name").alias("key")), files.select(F.lower("basename").alias("key"), "source_id"), "by_name")
    by_tag = _only_source(documents.select("id", F.lower("tag").alias("key")), words, "by_tag")
    return documents.select("id").join(by_name, "id", "left").join(by_tag, "id", "left").select("id", F.coalesce("by_name", "by_tag").alias("source_id"))


def _only_source(asked: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(id, name): the one source_id of files(key, source_id) under the keys of asked(id, key). Sources are counted by key before rows meet."""
    held = files.groupBy("key").agg(F.count_distinct("source_id").alias("n"), F.min("source_id").alias("s"))
    found = asked.join(held, "key").groupBy("id").agg(F.max("n").alias("n"), F.min("s").alias(name), F.max("s").alias("other"))
    return found.where((F.col("n") == 1) & (F.col(name) == F.col("other"))).select("id", name)


def run_values(parameters: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """parameters(name, value) whose name ends like a run setting, if one value is stated: setting, value."""
    rows = [parameters.where(F.col("name").endswith(s)).select(F.lit(target).alias("setting"), "value") for s, target in suffixes.items()]
    return reduce(DataFrame.unionAll, rows).groupBy("setting").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")


def run_span(trace: DataFrame) -> DataFrame:
    """trace(series, t): start, stop and step of a reference run (span over the number of its intervals)."""
    return trace.groupBy("series").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.when(F.count("*") > 1, (F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("step"))


def only_value(required: DataFrame, stated: DataFrame) -> DataFrame:
    """Parts whose kind asks for one parameter and that state one value under another name: the value is adopted."""
    one = required.groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").drop("n")
    val = stated.groupBy("part", "kind").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")
    return val.join(one, "kind").select("part", "name", "value")


def renamed(traces: DataFrame, names: DataFrame) -> DataFrame:
    """traces(id, source_id) with sources renamed by names(old, new)."""
    return traces.join(names, traces.source_id == names.old, "left").select("id", F.coalesce("new", "source_id").alias("source_id"))


def foreign_links(uses: DataFrame, ports: DataFrame, wired: DataFrame) -> DataFrame:
    """uses(user, port, text): ports of other parts that are not wired and whose part the text mentions. ports(port, part, name), wired(port)."""
    from proofline.functions.text import mentions

    j = uses.join(ports, "port").where("user <> part").join(wired.select("port"), "port", "left_anti")
    return j.where(mentions(F.col("text"), F.col("name"))).select("user", "port").distinct()


def feeds_one(links: DataFrame) -> DataFrame:
    """links(from_port, to_port): outputs that are wired to one input alone."""
    return links.groupBy("from_port").agg(F.count_distinct("to_port").alias("n"), F.min("to_port").alias("to_port")).where("n = 1").drop("n")


def assumptions_of(elements: DataFrame, assumptions: DataFrame) -> DataFrame:
    """elements(id) with the number of assumptions(assumption, affects array) that affect them."""
    hit = assumptions.select("assumption", F.explode("affects").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("assumptions"))
    return elements.select("id").join(hit, "id", "left").select("id", F.coalesce("assumptions", F.lit(0)).alias("assumptions"))


def gate_lines(stages: DataFrame) -> DataFrame:
    """stages(gate, status, reason) as report lines; a gate without a status did not run."""
    said = F.when(F.col("status").isNull(), F.concat(F.lit("NOT RUN: "), F.coalesce("reason", F.lit("no result")))).otherwise(F.col("status"))
    return stages.select("gate", F.concat(F.col("gate"), F.lit(": "), said).alias("line"))


def conditions(transitions: DataFrame) -> DataFrame:
    """Distinct guards of a machine in the order in which they first stand: machine, n, guard. transitions(machine, ord, guard)."""
    from pyspark.sql import Window

    first = transitions.where("guard is not null").groupBy("machine", "guard").agg(F.min("ord").alias("at"))
    return first.select("machine", F.row_number().over(Window.partitionBy("machine").orderBy("at")).alias("n"), "guard")


def tolerance(parameters: DataFrame, default: float) -> DataFrame:
    """The stated time tolerance with the smallest id (a system value in seconds named so), else the declared default: value, stated."""
    told = parameters.where("owner = 'system' and name like '%tolerance%' and unit = 's' and status in ('verification_only', 'effective')").agg(F.min_by("value", "id").alias("v"))
    return told.select(F.coalesce("v", F.lit(default)).alias("value"), F.col("v").isNotNull().alias("stated"))


def winners(candidates: DataFrame) -> DataFrame:
    """candidates(conflict, value, resolution) that hold the resolution."""
    return candidates.where(F.col("value") == F.col("resolution"))


def wave(rows: DataFrame, statements: Column) -> DataFrame:
    """Which of two waves a chunk is read in: registers that are no statements first."""
    return rows.withColumn("wave", F.when((F.col("role") == "register") & ~statements, 1).otherwise(2))
