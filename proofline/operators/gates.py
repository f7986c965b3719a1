"""Integrity queries (each must give no row), the honesty gate and gaps that the catalogue fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.skew import numbered


def repeated_ids(tables: list[DataFrame], id_: str = "id") -> DataFrame:
    """Ids that occur more than once over all tables: id, n."""
    return reduce(DataFrame.unionAll, [t.select(F.col(id_).cast("string").alias("id")) for t in tables]).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set but no parent has it."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row (that meets the condition): keys, n."""
    return (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def untraced(elements: DataFrame) -> DataFrame:
    """Of elements(id, traces, assumptions), those with neither."""
    return elements.where((F.coalesce(F.size("traces"), F.lit(0)) <= 0) & (F.coalesce(F.size("assumptions"), F.lit(0)) <= 0))


def bad_links(links: DataFrame, ports: DataFrame) -> DataFrame:
    """links(id, a, b) whose ends are unknown, have different domains or wrong directions, with the reason. ports(port, domain, direction)."""
    a = ports.select(F.col("port").alias("a"), F.col("domain").alias("da"), F.col("direction").alias("ra"))
    b = ports.select(F.col("port").alias("b"), F.col("domain").alias("db"), F.col("direction").alias("rb"))
    reason = F.when(F.col("da").isNull() | F.col("db").isNull(), "unknown end").when(F.col("da") != F.col("db"), "domains differ").when(~F.col("ra").isin("out", "inout") | ~F.col("rb").isin("in", "inout"), "wrong direction")
    return links.join(a, "a", "left").join(b, "b", "left").withColumn("reason", reason).where("reason is not null").select("id", "reason")


def bad_parameters(parameters: DataFrame, owners: DataFrame, si_units: list[str]) -> DataFrame:
    """parameters(id, owner, unit) without a known owner or in a unit outside the SI set, with the reason."""
    known = owners.select(F.col("id").alias("owner"), F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "unknown owner").when(~F.col("unit").isin(si_units), "not an SI unit")
    return parameters.join(known, "owner", "left").withColumn("reason", reason).where("reason is not null").select("id", "reason")


def bad_requirements(rows: DataFrame) -> DataFrame:
    """rows(id, status, superseded_by): superseded without a successor, a successor without being superseded, or an unknown successor."""
    known = rows.select(F.col("id").alias("superseded_by"), F.lit(True).alias("known")).distinct()
    reason = F.when((F.col("status") == "superseded") & F.col("superseded_by").isNull(), "no successor").when((F.col("status") != "superseded") & F.col("superseded_by").isNotNull(), "successor of an active one").when(F.col("superseded_by").isNotNull() & F.col("known").isNull(), "unknown successor")
    return rows.join(known, "superseded_by", "left").withColumn("reason", reason).where("reason is not null").select("id", "reason")


def bad_criteria(rows: DataFrame) -> DataFrame:
    """rows(id, reason, mode, start_s, end_s): neither check nor reason, `at` without a start, or an end before the start."""
    why = F.when(F.col("mode").isNull() & F.col("reason").isNull(), "neither check nor reason").when((F.col("mode") == "at") & F.col("start_s").isNull(), "no start").when(F.col("start_s") > F.col("end_s"), "ends before it starts")
    return rows.withColumn("why", why).where("why is not null").select("id", F.col("why").alias("reason"))


def honesty(levels: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Removal cascade: levels of (kind, rows(id, parent, traced)), top first; a row goes if it is untraced or its parent went.

    Returns kept(kind, id) and rejected(kind, id, reason). The parent of the first level is not asked for.
    """
    kept_all, gone_all, parents = [], [], None
    for kind, rows in levels:
        own = rows.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), "traced")
        if parents is None:
            judged = own.withColumn("alive", F.lit(True))
        else:
            judged = own.join(parents.select(F.col("id").alias("parent"), F.lit(True).alias("alive")), "parent", "left")
        reason = F.when(~F.coalesce("traced", F.lit(False)), "no trace and no assumption").when(F.col("alive").isNull(), "it depends on a removed element")
        judged = judged.withColumn("reason", reason)
        parents = judged.where("reason is null").select("id")
        kept_all.append(parents.select(F.lit(kind).alias("kind"), "id"))
        gone_all.append(judged.where("reason is not null").select(F.lit(kind).alias("kind"), "id", "reason"))
    return reduce(DataFrame.unionAll, kept_all), reduce(DataFrame.unionAll, gone_all)


def missing_parameters(parts: DataFrame, required: DataFrame, stated: DataFrame) -> DataFrame:
    """Required parameters that a part lacks: part, kind, name, default (null: a question). parts(part, kind), required(kind, name, default), stated(part, name)."""
    return parts.join(required, "kind").join(stated.select("part", "name"), ["part", "name"], "left_anti").select("part", "kind", "name", "default", F.when(F.col("default").isNull(), "question").otherwise("assumption").alias("outcome"))


def conventions(parameters: DataFrame, rules: DataFrame) -> DataFrame:
    """parameters(owner, name, value) with rules(source, target) applied: where the target is missing it takes the source's value."""
    wanted = parameters.join(rules, parameters.name == rules.source).select("owner", F.col("target").alias("name"), "value")
    return parameters.select("owner", "name", "value").unionAll(wanted.join(parameters.select("owner", "name"), ["owner", "name"], "left_anti"))


def stated_assumptions(hints: DataFrame) -> DataFrame:
    """hints(text, affects array, ord): one per exact text with the union of what it affects, numbered as first seen."""
    each = hints.groupBy("text").agg(F.min("ord").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("affects")))).alias("affects"))
    return numbered(each, "at").drop("at")
