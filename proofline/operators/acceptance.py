"""Criteria on a run: `always`, `eventually` and `at` over a window, with reasons where nothing can be said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.expressions import ConditionError, compile_, compile_steps, parse, run_steps, steps
from proofline.functions.numbers import event_slack
from proofline.operators.skew import joined_same
from proofline.storage import materialise


def evaluate(run: DataFrame, mode: str, condition: str, names: dict[str, str], start: float | None = None, end: float | None = None, truths: tuple[str, ...] = (), states: dict[str, tuple[str, int]] | None = None, complete: bool = True) -> DataFrame:
    """run(series, ord, t, columns) judged by one condition: series, status, samples, at.

    names maps the condition's names to columns; truths are names whose column is true above 0.5; states maps a state to
    its column and number. The window holds the value in force at its start and all rows after it and before its end.
    """

    def name(n: str) -> Column:
        if n not in names:
            raise ConditionError(f"{n} has no series")
        return F.col(names[n]) > 0.5 if n in truths else F.col(names[n])

    def state(s: str) -> Column:
        if s not in (states or {}):
            raise ConditionError(f"in_state({s}) has no series")
        column, number = states[s]
        return F.round(F.col(column)) == number

    spans = run.groupBy("series").agg(F.min("t").alias("run_start"), F.max("t").alias("run_end"))
    try:
        holds = F.coalesce(compile_(parse(condition), name, state).cast("boolean"), F.lit(False))
    except ConditionError as why:
        return spans.select("series", F.lit("NOT CHECKED").alias("status"), F.lit(0).cast("long").alias("samples"), F.lit(None).cast("double").alias("at"), F.lit(str(why)).alias("reason"))
    first = F.lit(start).cast("double") if start is not None else F.col("run_start")
    last = F.lit(end).cast("double")
    rows = run.withColumn("holds", holds).join(spans.withColumn("first", first), "series")
    slack = event_slack(F.col("first"))
    inside = (F.col("t") > F.col("first") + slack) & (last.isNull() | (F.col("t") < last - event_slack(last)))
    upto = F.col("t") <= F.col("first") + slack
    place = F.struct("t", "ord")
    found = rows.groupBy("series").agg(
        F.first("first").alias("first"), F.first("run_end").alias("run_end"), F.max_by("holds", F.when(upto, place)).alias("at_start"), F.count_if(upto).alias("before"), F.count_if(inside).alias("n"),
        F.min(F.when(inside & ~F.col("holds"), F.col("t"))).alias("violated"), F.min(F.when(inside & F.col("holds"), F.col("t"))).alias("held"),
    )
    samples = F.col("n") + F.when(F.col("before") > 0, 1).otherwise(0)
    violated = F.when((F.col("before") > 0) & ~F.col("at_start"), F.col("first")).otherwise(F.col("violated"))
    held = F.when((F.col("before") > 0) & F.col("at_start"), F.col("first")).otherwise(F.col("held"))
    late = F.col("first") > F.col("run_end") + event_slack(F.col("run_end"))
    past = (last > F.col("run_end") + event_slack(F.col("run_end"))) if end is not None else F.lit(not complete)
    unchecked = late | (F.lit(mode != "at") & past) | (samples == 0)
    verdict = {
        "at": F.when(F.col("at_start"), "PASS").otherwise("FAIL"), "always": F.when(violated.isNull(), "PASS").otherwise("FAIL"), "eventually": F.when(held.isNotNull(), "PASS").otherwise("FAIL"),
    }[mode]
    when = {"at": F.when(~F.col("at_start"), F.col("first")), "always": violated, "eventually": held}[mode]
    reason = F.when(late, "starts after the run ended").when(F.lit(mode != "at") & past, "the window runs past the end of the run").when(samples == 0, "no samples inside the window")
    return found.select("series", F.when(unchecked, "NOT CHECKED").otherwise(verdict).alias("status"), F.when(unchecked, 0).otherwise(samples).cast("long").alias("samples"), F.when(~unchecked, when).alias("at"), F.when(unchecked, reason).alias("reason"))


BROADCAST_ROWS = 20_000
COMPILED = 64  # so many different conditions become columns; with more, all are evaluated by a fold


def evaluate_all(run: DataFrame, criteria: DataFrame, truths: tuple[str, ...] = (), states: dict[str, tuple[str, int]] | None = None, complete: bool = True) -> DataFrame:
    """Many criteria in one job: id, series, status, samples, at, reason, by the rules of `evaluate`.

    run(series, ord, t, values: a map from names to numbers) and criteria(id, series, mode, condition, start, end). Each
    different condition is read once, as postfix steps. Criteria that share series, condition and window share its samples'
    evaluation: by the condition as a column where few conditions differ, else by a fold over its steps, so the plan does not
    grow with the criteria. A criterion whose series has no rows gives no result.
    """
    spans = run.groupBy("series").agg(F.min("t").alias("run_start"), F.max("t").alias("run_end"))
    known = run.select("series", F.explode(F.map_keys("values")).alias("name")).distinct().groupBy("series").agg(F.collect_set("name").alias("known"))
    of_state = F.create_map(*(F.lit(x) for s, (c, n) in (states or {}).items() for x in (s, c))) if states else F.expr("cast(map() as map<string,string>)")
    number = F.create_map(*(F.lit(x) for s, (_, n) in (states or {}).items() for x in (s, float(n)))) if states else F.expr("cast(map() as map<string,double>)")
    asked = criteria.select("id", "series", "mode", F.coalesce("condition", F.lit("")).alias("condition"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("last"))
    programs = materialise(asked.select("condition").distinct().withColumn("p", steps(F.col("condition"))).select("condition", "p.steps", F.col("p.reason").alias("unread")), "programs")
    listed = programs.limit(COMPILED + 1).collect()
    few = len(listed) <= COMPILED
    asked = asked.join(F.broadcast(programs) if few else programs, "condition").join(spans, "series").join(known, "series", "left")
    lost = F.filter("steps", lambda s: (s["what"] == "timer_expired") | ((s["what"] == "in_state") & of_state[s["name"]].isNull()) | ((s["what"] == "name") & ~F.coalesce(F.array_contains("known", s["name"]), F.lit(False))))
    first_lost = F.get(lost, F.lit(0))
    no_series = F.when(first_lost["what"] == "name", F.concat(first_lost["name"], F.lit(" has no series"))).when(first_lost.isNotNull(), F.concat(first_lost["what"], F.lit("("), first_lost["name"], F.lit(") has no series")))
    asked = asked.withColumn("why", F.coalesce("unread", no_series)).withColumn("first", F.coalesce("start", "run_start"))
    asked = materialise(asked.select("id", "series", "mode", "condition", "first", "last", "run_end", "why"), "criteria")
    able = asked.where("why is null").select("series", "condition", "first", "last").distinct()
    able = able if few else able.join(programs.select("condition", "steps"), "condition")
    able = materialise(able, "windows")
    able = F.broadcast(able) if able.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else able.hint("merge")

    def value(name: Column) -> Column:
        own = F.col("values")[name]
        return F.when(name.isin(*truths), (own > 0.5).cast("double")).otherwise(own) if truths else own

    def state(name: Column) -> Column:
        return F.round(F.col("values")[of_state[name]]) == number[name]

    rows = run.join(able, "series").where(F.col("last").isNull() | (F.col("t") < F.col("last")))
    told = F.lit(None).cast("double") if few else run_steps(F.col("steps"), value, state)
    for r in (r for r in listed if few and r.unread is None and not any(_lost(x, states or {}) for x in r.steps)):
        told = F.when(F.col("condition") == r.condition, compile_steps(r.steps, value, lambda n: F.round(F.col("values")[states[n][0]]) == float(states[n][1]))).otherwise(told)
    rows = rows.withColumn("holds", F.coalesce(told != 0, F.lit(False)))
    slack = event_slack(F.col("first"))
    inside = (F.col("t") > F.col("first") + slack) & (F.col("last").isNull() | (F.col("t") < F.col("last") - event_slack(F.col("last"))))
    upto = F.col("t") <= F.col("first") + slack
    found = rows.groupBy("series", "condition", "first", "last").agg(
        F.max_by("holds", F.when(upto, F.struct("t", "ord"))).alias("at_start"), F.count_if(upto).alias("before"), F.count_if(inside).alias("n"), F.min(F.when(inside & ~F.col("holds"), F.col("t"))).alias("bad"), F.min(F.when(inside & F.col("holds"), F.col("t"))).alias("good")
    )
    j = joined_same(asked, found, ["series", "condition", "first", "last"], "left").withColumns({"before": F.coalesce("before", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    samples = F.col("n") + F.when(F.col("before") > 0, 1).otherwise(0)
    violated = F.when((F.col("before") > 0) & ~F.col("at_start"), F.col("first")).otherwise(F.col("bad"))
    held = F.when((F.col("before") > 0) & F.col("at_start"), F.col("first")).otherwise(F.col("good"))
    over = event_slack(F.col("run_end"))
    late = F.col("first") > F.col("run_end") + over
    past = (F.col("mode") != "at") & F.when(F.col("last").isNotNull(), F.col("last") > F.col("run_end") + over).otherwise(F.lit(not complete))
    reason = F.coalesce("why", F.when(late, "starts after the run ended").when(past, "the window runs past the end of the run").when(samples == 0, "no samples inside the window"))
    ok = F.when(F.col("mode") == "at", F.coalesce("at_start", F.lit(False))).when(F.col("mode") == "always", violated.isNull()).otherwise(held.isNotNull())
    when = F.when(F.col("mode") == "at", F.when(~F.col("at_start"), F.col("first"))).when(F.col("mode") == "always", violated).otherwise(held)
    judged = j.withColumn("reason", reason)
    return judged.select(
        "id", "series", F.when(F.col("reason").isNotNull(), "NOT CHECKED").when(ok, "PASS").otherwise("FAIL").alias("status"), F.when(F.col("reason").isNull(), samples).otherwise(0).cast("long").alias("samples"),
        F.when(F.col("reason").isNull(), when).alias("at"), "reason",
    )


def _lost(step, states: dict) -> bool:
    """Whether no series can have this step."""
    return step["what"] == "timer_expired" or (step["what"] == "in_state" and step["name"] not in states)


def results(criteria: DataFrame, evaluated: DataFrame, stopped_by: str | None = None, not_run: str | None = None) -> DataFrame:
    """One result a criterion of criteria(id, checkable, reason), by evaluated(id, status, reason) where it was evaluated.

    stopped_by is the message of the assertion that ended the run: a criterion that it begins with (`id:`) has failed. not_run
    says why there is no run at all. What has no check is not checked, for its stated reason.
    """
    j = criteria.select("id", "checkable", F.col("reason").alias("stated")).join(evaluated.select("id", F.col("status").alias("found"), F.col("reason").alias("why")), "id", "left")
    failed = F.lit(stopped_by).startswith(F.concat(F.col("id").cast("string"), F.lit(":"))) if stopped_by else F.lit(False)
    none = F.lit(not_run is not None) | F.col("found").isNull()
    status = F.when(failed, "FAIL").when(~F.col("checkable") | none, "NOT CHECKED").otherwise(F.col("found"))
    missing = F.lit(f"not evaluated: {not_run or 'there is no simulation result'}")
    reason = F.when(failed, F.lit(stopped_by)).when(~F.col("checkable"), F.coalesce("stated", F.lit("no machine-checkable form"))).when(none, missing).otherwise(F.col("why"))
    return j.select("id", status.alias("status"), reason.alias("reason"))


def overall(statuses: DataFrame, ran: Column) -> DataFrame:
    """One verdict per run of statuses(run, status): FAIL wins, then NOT RUN, PASS only if something passed, else NOT CHECKED."""
    found = statuses.groupBy("run").agg(F.bool_or(F.col("status") == "FAIL").alias("failed"), F.bool_or(F.col("status") == "PASS").alias("passed"), F.bool_and(ran).alias("ran"))
    return found.select("run", F.when(F.col("failed"), "FAIL").when(~F.col("ran"), "NOT RUN").when(F.col("passed"), "PASS").otherwise("NOT CHECKED").alias("verdict"))
