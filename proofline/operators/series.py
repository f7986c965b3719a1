"""Time series: values in force, interpolation, changes, and the comparison of a run with a reference.

Rows carry series, ord and t; two rows may share one t, then the later ord is the value after the event. To keep a series
that holds much of the data out of one task, time is cut into buckets of `width`; each bucket is worked on by itself and
gets the last (or next) value of the buckets around it from a table with one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.storage import materialise


def _bucketed(rows: DataFrame, width: float) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col("t") / width))


def _carry(rows: DataFrame, value: str, keys: list[str], forward: bool, order: list[str]) -> DataFrame:
    """(keys, bucket, carried): the last value before a bucket, or the first one after it. Only rows with a value count."""
    place = F.struct(*order)
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, "bucket").agg((F.max_by if forward else F.min_by)(value, place).alias("end"))
    every = rows.select(*keys, "bucket").distinct().join(ends, [*keys, "bucket"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket" if forward else F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*keys, "bucket", F.last("end", True).over(w).alias("carried"))


def fill(rows: DataFrame, value: str, out: str, keys: list[str], order: list[str], width: float, forward: bool = True, own: bool = True) -> DataFrame:
    """`rows` with the last value so far (or the next one) as `out`, nulls skipped; own: a row's own value counts."""
    b = _bucketed(rows, width)
    direction = [F.col(c) if forward else F.desc(c) for c in order]
    w = Window.partitionBy(*keys, "bucket").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    inside = b.withColumn("__in", F.last(value, True).over(w))
    return inside.join(_carry(b, value, keys, forward, order), [*keys, "bucket"]).withColumn(out, F.coalesce("__in", "carried")).drop("__in", "carried", "bucket")


def hold(trace: DataFrame, asked: DataFrame, width: float) -> DataFrame:
    """`asked(series, t, ...)` with value: the one in force at t, after events at t; before the first sample the first value."""
    side = trace.select("series", "t", "ord", "value", F.lit(0).alias("side"))
    both = side.unionByName(asked.select("series", "t", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")))
    filled = fill(both, "value", "held", ["series"], ["t", "side", "ord"], width)
    first = trace.groupBy("series").agg(F.min_by("value", F.struct("t", "ord")).alias("first"))
    return filled.where("side = 1").join(first, "series", "left").select("series", "t", F.coalesce("held", "first").alias("value"))


def interpolate(trace: DataFrame, asked: DataFrame, width: float) -> DataFrame:
    """`asked(series, t)` with value between the samples around t; at a sample its (later) value, outside the span the end's."""
    point = F.struct(F.col("t").alias("t"), F.col("value").alias("v"))
    side = trace.select("series", "t", "ord", point.alias("p"), F.lit(0).alias("side"))
    both = side.unionByName(asked.select("series", "t", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("struct<t:double,v:double>").alias("p"), F.lit(1).alias("side")))
    before = fill(both, "p", "a", ["series"], ["t", "side", "ord"], width)
    after = fill(before, "p", "b", ["series"], ["t", "side", "ord"], width, forward=False)
    exact = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    value = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("a.t") == F.col("t")), F.col("a.v")).otherwise(exact)
    return after.where("side = 1").select("series", "t", value.alias("value"))


def changes(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Rows whose value differs from the row before: series, t, ord, value, n (from 1)."""
    before = fill(rows, value, "before", ["series"], ["t", "ord"], width, own=False)
    changed = before.where(F.col("before").isNotNull() & (F.col(value) != F.col("before"))).select("series", "t", "ord", F.col(value).alias("value"))
    b = _bucketed(changed, width)
    counts = b.groupBy("series", "bucket").agg(F.count("*").alias("c"))
    base = counts.select("series", "bucket", F.coalesce(F.sum("c").over(Window.partitionBy("series").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("series", "bucket").orderBy("t", "ord"))
    return b.withColumn("i", inside).join(base, ["series", "bucket"]).select("series", "t", "ord", "value", (F.col("i") + F.col("base")).alias("n"))


def pair_changes(reference: DataFrame, run: DataFrame, tolerance: float) -> DataFrame:
    """The k-th change of the reference beside the k-th of the run: series, n, values, times, time_error and ok."""
    a = reference.select("series", "n", F.col("t").alias("reference_time"), F.col("value").alias("reference_value"))
    b = run.select("series", "n", F.col("t").alias("run_time"), F.col("value").alias("run_value"))
    error = F.abs(F.col("run_time") - F.col("reference_time"))
    return a.join(b, ["series", "n"], "full").withColumns({"time_error": error, "ok": F.coalesce(F.col("reference_value").eqNullSafe(F.col("run_value")) & (error <= tolerance), F.lit(False))})


def continuous_error(samples: DataFrame, fraction: float) -> DataFrame:
    """samples(series, t, want, got): max_abs_error, at_time (the first worst), max_rel_error, samples, limit and status.

    The limit is a fraction of the reference's range, or of its largest size if that is 0, or of 1.
    """
    error = F.abs(F.col("got") - F.col("want"))
    found = samples.withColumn("error", error).groupBy("series").agg(
        F.max("error").alias("max_abs_error"), F.max(F.struct("error", (-F.col("t")).alias("t"))).alias("worst"), F.max(F.when(F.abs("want") > 1e-12, F.col("error") / F.abs("want")).otherwise(0.0)).alias("max_rel_error"), F.count("*").alias("samples"),
        F.coalesce(F.nullif(F.max("want") - F.min("want"), F.lit(0.0)), F.nullif(F.max(F.abs("want")), F.lit(0.0)), F.lit(1.0)).alias("spread"),
    )
    limit = fraction * F.col("spread")
    return found.select("series", "max_abs_error", (-F.col("worst.t")).alias("at_time"), "max_rel_error", "samples", limit.alias("limit"), F.when(F.col("max_abs_error") <= limit, "PASS").otherwise("FAIL").alias("status"))


def discrete_verdict(pairs: DataFrame) -> DataFrame:
    """Of pair_changes(): reference_changes, run_changes, max_time_error and status of each series."""
    return pairs.groupBy("series").agg(
        F.count("reference_time").alias("reference_changes"), F.count("run_time").alias("run_changes"), F.coalesce(F.max("time_error"), F.lit(0.0)).alias("max_time_error"), F.when(F.bool_and("ok"), "PASS").otherwise("FAIL").alias("status")
    )


def span(a: DataFrame, b: DataFrame) -> DataFrame:
    """The time that both cover, by series: start, end."""
    x, y = (d.groupBy("series").agg(F.min("t").alias(f"s{i}"), F.max("t").alias(f"e{i}")) for i, d in enumerate((a, b)))
    return x.join(y, "series").select("series", F.greatest("s0", "s1").alias("start"), F.least("e0", "e1").alias("end"))


def early_stop(reference: DataFrame, run: DataFrame, tolerance: float) -> DataFrame:
    """Series whose run ends before the reference does: they fail as a whole."""
    a, b = (d.groupBy("series").agg(F.max("t").alias(n)) for d, n in ((reference, "reference_end"), (run, "run_end")))
    return a.join(b, "series").where(F.col("run_end") < F.col("reference_end") - tolerance)


def map_states(columns: DataFrame, machines: DataFrame) -> DataFrame:
    """columns(column, values array) to the one machine(machine, aliases array) that knows all its values; null if none or several."""
    found = contained(columns.select("column", "values"), machines.select("machine", "aliases"))
    return columns.select("column").join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("fits"), F.when(F.col("n") == 1, F.col("first")).alias("machine"))


def contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each of asked(id, members): n, how many of known(id, members) hold all of its members, and first, the smallest id of these.

    Equal sets are one set on both sides, with how many have it. A set meets only those that hold its rarest member, and is
    compared there in full; so a member that all have pairs nothing. Ids without members, and those that none holds, are left out.
    """
    (a, a_set), (b, b_set) = asked.columns, known.columns
    each = asked.select(a, F.array_sort(F.array_distinct(a_set)).alias("members")).where(F.size("members") > 0)
    sets = known.select(b, F.array_sort(F.array_distinct(b_set)).alias("holds")).groupBy("holds").agg(F.count("*").alias("n"), F.min(b).alias("first"))
    sets = materialise(sets, "sets").where(F.size("holds") > 0)
    held = sets.select(F.explode("holds").alias("member")).groupBy("member").agg(F.count("*").alias("often"))
    wanted = each.select("members").distinct()
    rarest = wanted.select("members", F.explode("members").alias("member")).join(held, "member", "left").groupBy("members").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "member")).alias("r"))
    pairs = rarest.where("r.often > 0").select("members", F.col("r.member").alias("member")).join(sets.select(F.explode("holds").alias("member"), "holds", "n", "first"), "member")
    fits = pairs.where(F.size(F.array_except("members", "holds")) == 0).groupBy("members").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return each.join(fits, "members").select(a, "n", "first")


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(id, token) to the right(name, token) that shares most distinct tokens: id, hits, name (null on a tie)."""
    shared = left.distinct().join(right.distinct(), "token").groupBy("id", "name").agg(F.count("*").alias("hits"))
    level = shared.groupBy("id", "hits").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return level.groupBy("id").agg(F.max("hits").alias("hits"), F.max_by(F.struct("n", "name"), "hits").alias("b")).select("id", "hits", F.when(F.col("b.n") == 1, F.col("b.name")).alias("name"))


def signal_groups(signals: DataFrame) -> DataFrame:
    """signals(name, kind, unit, machine) by what is drawn together: states by machine, others by kind and unit."""
    key = F.when(F.col("kind") == "state", F.col("machine")).otherwise(F.coalesce("unit", F.lit("-")))
    return signals.groupBy("kind", key.alias("group")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def in_window(t: Column, start: Column, end: Column) -> Column:
    from proofline.functions.numbers import event_slack

    return (t > start + event_slack(start)) & (end.isNull() | (t < end - event_slack(end)))
