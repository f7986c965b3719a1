"""Competing values of one quantity: which applies, by which rule, and what becomes of the others.

Candidates have key, value, rank (1 is the most authoritative), date (may be null), stated (effective, superseded or
null) and ord. Every step aggregates before rows meet, so a key with very many candidates is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.numbers import close
from proofline.operators.skew import before_ranges, joined_same, running, sorted_ranges

# Authority of a source's role; an unapproved change record ranks last.
RANK = {
    "change_record": 1, "review_decision": 2, "requirement_spec": 3, "design_note": 3, "register": 3, "datasheet": 4, "legacy_model": 5, "legacy_architecture": 5, "correspondence": 6,
    "informal_note": 6, "other": 6, "verification_procedure": 6, "reference_data": 6,
}
LOWEST = 6


def rank_of(role: Column, approved: Column | None = None) -> Column:
    """Authority rank of a role."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in RANK.items() for x in p)), role), F.lit(LOWEST))
    return rank if approved is None else F.when((role == "change_record") & ~approved, LOWEST).otherwise(rank)


def values(candidates: DataFrame) -> DataFrame:
    """One row per key and value: rank, its latest date at that rank, first (its best place), marked, live, n."""
    by_rank = candidates.groupBy("key", "value", "rank").agg(
        F.max("date").alias("date"), F.min("ord").alias("ord"), F.bool_or(F.coalesce(F.col("stated") == "effective", F.lit(False))).alias("marked"), F.bool_or(~F.coalesce(F.col("stated") == "superseded", F.lit(False))).alias("live"), F.count("*").alias("n")
    )
    return by_rank.groupBy("key", "value").agg(
        F.min("rank").alias("rank"), F.min_by("date", "rank").alias("date"), F.min(F.struct("rank", "ord")).alias("first"), F.bool_or("marked").alias("marked"), F.bool_or("live").alias("live"), F.sum("n").alias("n")
    )


def choose(found: DataFrame) -> DataFrame:
    """Of values(): key, winner, rule (single, status, ladder, later or tie) and losers.

    Status words come first: the only value marked effective, else, if none is, the only one not marked superseded
    throughout. Then the best rank, then the later date; a missing date among the best is a tie, which the first in order
    holds for the time being.
    """
    by_date = found.groupBy("key", "rank", "date").agg(F.count("*").alias("c"), F.min(F.struct("first", "value")).alias("first"))
    by_rank = by_date.groupBy("key", "rank").agg(F.sum("c").alias("c"), F.bool_and(F.col("date").isNotNull()).alias("dated"), F.max_by(F.struct("c", "first"), "date").alias("latest"), F.min("first").alias("first"))
    top = by_rank.groupBy("key").agg(F.min_by(F.struct("c", "dated", "latest", "first"), "rank").alias("top"))
    words = found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("marked").alias("n_marked"), F.min(F.when(F.col("marked"), F.col("value"))).alias("marked"), F.count_if("live").alias("n_live"), F.min(F.when(F.col("live"), F.col("value"))).alias("live"))
    j = words.join(top, "key")
    later = F.col("top.dated") & (F.col("top.latest.c") == 1)
    rule = F.when(F.col("n") == 1, "single").when(F.col("n_marked") == 1, "status").when((F.col("n_marked") == 0) & (F.col("n_live") == 1), "status").when(F.col("top.c") == 1, "ladder").when(later, "later").otherwise("tie")
    winner = F.when(F.col("rule") == "single", F.col("top.first.value")).when(F.col("n_marked") == 1, F.col("marked")).when(F.col("rule") == "status", F.col("live")).when(F.col("rule") == "later", F.col("top.latest.first.value")).otherwise(F.col("top.first.value"))
    return j.withColumn("rule", rule).select("key", winner.alias("winner"), "rule", (F.col("n") - 1).alias("losers"))


def superseded(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Values that did not win: key, value, rank."""
    return found.join(chosen.select("key", "winner"), "key").where("value <> winner").select("key", "value", "rank")


def conflicts(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keys with several values: n_candidates, best_rank and the resolution (unresolved on a tie)."""
    per = found.groupBy("key").agg(F.count("*").alias("n_candidates"), F.min("rank").alias("best_rank"))
    return per.where("n_candidates > 1").join(chosen, "key").select("key", "n_candidates", "best_rank", F.when(F.col("rule") == "tie", "unresolved").otherwise(F.col("winner").cast("string")).alias("resolution"))


def questions(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ties: key, the values of the best rank, and the default if nobody answers."""
    best = found.join(chosen.where("rule = 'tie'").select("key", "winner"), "key").withColumn("top", F.min("rank").over(Window.partitionBy("key"))).where("rank = top")
    return best.groupBy("key").agg(F.count("*").alias("options"), F.min("winner").alias("default_if_unanswered"))


def clusters(rows: DataFrame, key: str, value: str, order: str, rel: float = 1e-9, abs_: float = 1e-12) -> DataFrame:
    """Values of a key that agree with a cluster's first member: key, head, members. Clusters depend on the order, as
    closeness is not transitive. Equal values are counted first; then a key's sorted values are cut at each gap that is wider
    than the tolerance, as nothing agrees across it, and only the values of such a chain are folded in their order."""
    each = rows.groupBy(key, value).agg(F.min(order).alias("at"), F.count("*").alias("n"))
    ranges = sorted_ranges(each, [key], [value])
    last = before_ranges(ranges, [key], F.max(value), lambda c: F.last(c, True)).withColumnRenamed("__before", "__last")
    below = F.lag(value).over(Window.partitionBy("__p", key).orderBy(value))
    joined = joined_same(ranges.withColumn("__below", below), F.broadcast(last), [key, "__p"], "left").withColumn("__below", F.coalesce("__below", "__last"))
    gap = F.when(F.col("__below").isNull() | ~close(F.col("__below"), F.col(value), rel, abs_), 1).otherwise(0)
    chained = running(joined.withColumn("__gap", gap).drop("__p", "__below", "__last"), "__gap", [value], "__chain", [key])
    listed = chained.groupBy(key, "__chain").agg(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"), "n"))).alias("l"))
    empty = F.expr("cast(array() as array<struct<v:double,n:bigint>>)")

    def step(done: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(done, lambda d: close(d["v"], x["v"], rel, abs_)), True)
        grown = F.transform(done, lambda d, i: F.when(i + 1 == hit, F.struct(d["v"].alias("v"), (d["n"] + x["n"]).alias("n"))).otherwise(d))
        return F.when(hit > 0, grown).otherwise(F.concat(done, F.array(F.struct(x["v"].alias("v"), x["n"].alias("n")))))

    return listed.select(key, F.explode(F.aggregate("l", empty, step)).alias("c")).select(key, F.col("c.v").alias("head"), F.col("c.n").alias("members"))


def merge_requirements(rows: DataFrame) -> DataFrame:
    """Statements with one id: the text of the best rank, superseded if any says so, the first successor that is not null."""
    place = F.struct("rank", "ord")
    return rows.groupBy("id").agg(F.min_by("text", place).alias("text"), F.bool_or("superseded").alias("superseded"), F.min_by("superseded_by", F.when(F.col("superseded_by").isNotNull(), place)).alias("superseded_by"), F.count("*").alias("statements"))


def only_owner(rows: DataFrame, name: str, owner: str) -> DataFrame:
    """Names that one owner alone holds: the owner is adopted."""
    return rows.groupBy(name).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias("owner")).where("n = 1").drop("n")
