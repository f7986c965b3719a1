"""State machines item by item: each item is kept, or discarded with a reason, against what was kept before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_any_state(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """Transitions from `*` become one from each state of the machine that has no own transition with that trigger."""
    own = transitions.where("from_state <> '*'")
    starred = transitions.where("from_state = '*'").drop("from_state").join(states.select("machine", F.col("state").alias("from_state")), "machine")
    new = starred.join(own.select("machine", "trigger", "from_state"), ["machine", "trigger", "from_state"], "left_anti").where("from_state <> to_state")
    return own.unionByName(new.select(own.columns))


def check_transitions(transitions: DataFrame, states: DataFrame, triggers: DataFrame) -> DataFrame:
    """transitions(machine, id, from_state, to_state, trigger) with the reason why one is discarded (null: kept)."""
    known = states.select("machine", "state").distinct()
    a = known.select("machine", F.col("state").alias("from_state"), F.lit(True).alias("has_from"))
    b = known.select("machine", F.col("state").alias("to_state"), F.lit(True).alias("has_to"))
    c = triggers.select("machine", "trigger", F.lit(True).alias("has_trigger")).distinct()
    j = transitions.join(a, ["machine", "from_state"], "left").join(b, ["machine", "to_state"], "left").join(c, ["machine", "trigger"], "left")
    reason = F.when(F.col("has_from").isNull(), "unknown source state").when(F.col("has_to").isNull(), "unknown target state").when(F.col("trigger").isNotNull() & F.col("has_trigger").isNull(), "unknown trigger")
    return j.select(*transitions.columns, reason.alias("reason"))


def renumber(transitions: DataFrame) -> DataFrame:
    """Priorities 1 to n within each state, in the stated order, unstated last."""
    return transitions.withColumn("priority", F.row_number().over(Window.partitionBy("machine", "from_state").orderBy(F.asc_nulls_last("priority"), "id")))


def unused_states(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """States that no transition reaches and none leaves."""
    touched = transitions.select("machine", F.col("from_state").alias("state")).union(transitions.select("machine", F.col("to_state").alias("state")))
    return states.join(touched, ["machine", "state"], "left_anti")


def state_outputs(states: DataFrame, ports: DataFrame, values: DataFrame) -> DataFrame:
    """For each machine and output port: the states in which it is true, and the states that give it no value. values(machine, state, port, truth)."""
    grid = states.select("machine", "state").join(ports.select("machine", "port"), "machine")
    j = grid.join(values, ["machine", "state", "port"], "left")
    return j.groupBy("machine", "port").agg(F.array_sort(F.collect_list(F.when(F.col("truth"), F.col("state")))).alias("true_in"), F.count_if(F.col("truth").isNull()).alias("without_value"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """attempts(run, attempt, has_machine, discarded): the first with a machine and the fewest discards."""
    return attempts.groupBy("run").agg(F.min_by("attempt", F.struct((~F.col("has_machine")).alias("none"), "discarded", "attempt")).alias("attempt"))
