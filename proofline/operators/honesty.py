"""Where every element comes from: trace rows with inheritance, records that must hold together, and what a report says of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.series import contained

# The groups of a trace report in their order; defaults of an experiment (seconds, intervals).
GROUPS = [
    "Parts", "Ports", "Connections", "Parameters", "State machines", "States", "Transitions", "Events", "Timers", "Regions",
    "Requirements", "Acceptance criteria", "Assumptions",
]
STOP_TIME, INTERVALS = 1.0, 500


def source_labels(sources: DataFrame) -> DataFrame:
    """sources(source_id, tags, revision) as the inputs cite them: the first tag, else the id, with the revision: source_id, label."""
    name = F.coalesce(F.get("tags", F.lit(0)), F.col("source_id").cast("string"))
    return sources.select("source_id", F.when(F.col("revision") != "", F.concat(name, F.lit(" Rev "), "revision")).otherwise(name).alias("label"))


def trace_rows(elements: DataFrame, assumptions: DataFrame, labels: DataFrame) -> DataFrame:
    """A row an element with its first source, or what it inherits, and the assumptions that touch it; a sink orders by place, id.

    elements(group, id, traces, own, inherits): traces is an array of (source_id, locator, quote), own its assumptions, inherits
    the element that answers for it. assumptions(assumption, affects). An element without traces inherits if it has no
    assumption of its own.
    """
    touched = assumptions.select("assumption", F.explode("affects").alias("id")).distinct().groupBy("id").agg(F.collect_set("assumption").alias("touching"))
    first = F.get("traces", F.lit(0))
    n = F.coalesce(F.size("traces"), F.lit(0))
    j = elements.join(touched, "id", "left").withColumn("source_id", first["source_id"]).join(labels, "source_id", "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    cited = F.concat(F.col("source_id").cast("string"), F.lit(" ("), F.coalesce("label", F.col("source_id").cast("string")), F.lit(")"))
    source = F.when(n > 0, cited).when(F.col("inherits").isNotNull() & (F.size(own) == 0), F.concat(F.lit("inherits "), "inherits")).otherwise("assumption only")
    locator = F.when(n > 0, F.concat(first["locator"], F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise("")))
    assumed = F.array_join(F.array_sort(F.array_union(own, F.coalesce("touching", F.array().cast("array<string>")))), ", ")
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    return j.select("group", place.cast("int").alias("place"), "id", source.alias("source"), F.coalesce(locator, F.lit("")).alias("locator"), F.when(n > 0, first["quote"]).otherwise("").alias("quote"), assumed.alias("assumed"))


def unsupported(elements: DataFrame, sources: DataFrame, assumptions: DataFrame) -> DataFrame:
    """elements(id, parent, sources, assumptions) that cite an unknown source or assumption, or have neither and no parent that has: id, reason."""
    a = elements.select("id", F.explode("sources").alias("source_id")).join(sources.select("source_id").distinct(), "source_id", "left_anti").select("id", F.lit("unknown source").alias("reason"))
    b = elements.select("id", F.explode("assumptions").alias("assumption")).join(assumptions.select("assumption").distinct(), "assumption", "left_anti").select("id", F.lit("unknown assumption").alias("reason"))
    has = (F.coalesce(F.size("sources"), F.lit(0)) > 0) | (F.coalesce(F.size("assumptions"), F.lit(0)) > 0)
    bare = elements.withColumn("has", has)
    parents = bare.select(F.col("id").alias("parent"), F.col("has").alias("parent_has"))
    c = bare.where("not has").join(parents, "parent", "left").where("not coalesce(parent_has, false)").select("id", F.lit("no trace and no assumption").alias("reason"))
    return a.distinct().union(b.distinct()).union(c)


def bad_records(records: DataFrame, elements: DataFrame) -> DataFrame:
    """records(id, affects) that name an element which elements(id) does not have: id, element."""
    return records.select("id", F.explode("affects").alias("element")).distinct().join(elements.select(F.col("id").alias("element")).distinct(), "element", "left_anti").select("id", "element")


def bad_conflicts(conflicts: DataFrame, candidates: DataFrame, elements: DataFrame, sources: DataFrame) -> DataFrame:
    """conflicts(id, subject) and candidates(id, source_id, element): unknown subject, source or element, fewer than two candidates."""
    known = elements.select(F.col("id").alias("element")).distinct()
    a = conflicts.join(known, conflicts.subject == known.element, "left_anti").select("id", F.lit("unknown subject").alias("reason"))
    b = candidates.join(sources.select("source_id").distinct(), "source_id", "left_anti").select("id", F.lit("unknown source"))
    c = candidates.where("element is not null").join(known, "element", "left_anti").select("id", F.lit("unknown element"))
    few = conflicts.join(candidates.groupBy("id").agg(F.count("*").alias("n")), "id", "left").where("coalesce(n, 0) < 2").select("id", F.lit("fewer than two candidates"))
    return a.union(b.distinct()).union(c.distinct()).union(few)


def bad_evidence(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """sources(source_id, status, reason) that repeat an id or were not read without a reason, chunks(chunk_id, source_id) of none: id, reason."""
    twice = sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source_id").cast("string").alias("id"), F.lit("repeated source").alias("reason"))
    silent = sources.where("status <> 'read' and coalesce(reason, '') = ''").select(F.col("source_id").cast("string"), F.lit("no reason"))
    lost = chunks.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(F.col("chunk_id").cast("string"), F.lit("unknown source"))
    return twice.union(silent).union(lost)


def bad_machines(machines: DataFrame, states: DataFrame, events: DataFrame, transitions: DataFrame, ports: DataFrame) -> DataFrame:
    """Faults of state machines: machine, item, reason.

    machines(machine, owner, initial); states(machine, state, outputs, actions); events(machine, event, port);
    transitions(machine, id, from_state, to_state, trigger, priority, actions); ports(port, part, direction). An event needs an
    input of the owner, an output an output of it; a state has each priority once; going to `history` needs a save_history.
    """
    flag = F.lit(True)
    own = machines.select("machine", "owner").join(ports.select("port", F.col("part").alias("owner"), "direction"), "owner").select("machine", "port", "direction")
    known = states.select("machine", "state", flag.alias("known")).distinct()

    def row(df: DataFrame, item: str, reason: str) -> DataFrame:
        return df.select("machine", F.col(item).cast("string").alias("item"), F.lit(reason).alias("reason"))

    def without(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
        return df.join(table.select("machine", F.col(table_key).alias(key)).distinct(), ["machine", key], "left_anti")

    inputs, outputs = own.where("direction <> 'out'"), own.where("direction <> 'in'")
    used = states.select("machine", F.explode("outputs").alias("port")).distinct()
    saves = states.select("machine", "actions").union(transitions.select("machine", "actions")).where(F.array_contains("actions", "save_history")).select("machine").distinct()
    back = transitions.where("to_state = 'history'").select("machine").distinct()
    shared = transitions.groupBy("machine", "from_state", "priority").agg(F.count("*").alias("n")).where("n > 1")
    found = [
        row(machines.join(ports.select(F.col("part").alias("owner")).distinct(), "owner", "left_anti"), "machine", "the owner has no ports"),
        row(without(machines, "initial", known, "state"), "initial", "the initial state is none of its states"),
        row(without(events, "port", inputs, "port"), "event", "the event's port is no input of the owner"),
        row(without(used, "port", outputs, "port"), "port", "not an output of the owner"),
        row(without(transitions, "from_state", known, "state"), "id", "from no state"),
        row(without(transitions.where("to_state <> 'history'"), "to_state", known, "state"), "id", "to no state"),
        row(without(transitions.where("trigger is not null"), "trigger", events, "event"), "id", "no such event"),
        row(shared, "from_state", "a priority is used twice"),
        row(back.join(saves, "machine", "left_anti"), "machine", "returns to history that nothing saves"),
    ]
    return reduce(DataFrame.unionAll, found)


def bad_catalogue(kinds: DataFrame, ports: DataFrame, mapped: DataFrame, parameters: DataFrame, measures: DataFrame, si_units: list[str]) -> DataFrame:
    """Faults of a catalogue: kind, item, reason.

    kinds(kind, dynamic); ports(kind, role, direction, unit); mapped(kind, role): its connectors; parameters(kind, name, mapped,
    needed, unit, assumption): assumption and unit of a default, else null; measures(kind, role, measured).
    """

    def row(df: DataFrame, item: str, reason: str) -> DataFrame:
        return df.select("kind", F.col(item).cast("string").alias("item"), F.lit(reason).alias("reason"))

    fixed = ports.join(kinds.where("not dynamic").select("kind"), "kind", "left_semi")
    named = parameters.where("not mapped")
    default = parameters.where("unit is not null or assumption is not null")
    outputs = ports.where("direction = 'out'").select(F.col("role").alias("measured")).distinct()
    found = [
        row(mapped.join(ports.select("kind", "role"), ["kind", "role"], "left_anti"), "role", "connector of no port"),
        row(fixed.join(mapped, ["kind", "role"], "left_anti"), "role", "port without a connector"),
        row(named, "name", "no parameter mapping"),
        row(default.where("trim(coalesce(assumption, '')) = ''"), "name", "no assumption text"),
        row(default.where(~F.coalesce(F.col("unit").isin(si_units), F.lit(False))), "name", "not an SI unit"),
        row(ports.where(F.col("unit").isNotNull() & ~F.col("unit").isin(si_units)), "role", "not an SI unit"),
        row(measures.join(ports.where("direction = 'in'").select("kind", "role"), ["kind", "role"], "left_anti"), "role", "measures by no input"),
        row(measures.join(outputs, "measured", "left_anti"), "measured", "no kind's output"),
    ]
    return reduce(DataFrame.unionAll, found)


def operands(uses: DataFrame, ports: DataFrame, parameters: DataFrame, outputs: DataFrame) -> DataFrame:
    """uses(machine, name) of guards: port, parameter or unknown, and whether a state of the machine writes it: machine, name, what, clash.

    ports(name), parameters(name), outputs(machine, name)."""
    flag = F.lit(True)
    j = uses.distinct().join(ports.select("name", flag.alias("p")).distinct(), "name", "left").join(parameters.select("name", flag.alias("q")).distinct(), "name", "left")
    j = j.join(outputs.select("machine", "name", flag.alias("w")).distinct(), ["machine", "name"], "left")
    return j.select("machine", "name", F.when(F.col("p"), "port").when(F.col("q"), "parameter").otherwise("unknown").alias("what"), F.coalesce("w", F.lit(False)).alias("clash"))


def asserted(criteria: DataFrame, uses: DataFrame, controllers: DataFrame) -> DataFrame:
    """criteria(id) that a controller can assert: all names that they use, of uses(id, name), are ones that it reads, of
    controllers(controller, name): id, controller (the first that can; null if none)."""
    able = contained(uses.groupBy("id").agg(F.collect_set("name").alias("names")), controllers.groupBy("controller").agg(F.collect_set("name").alias("reads")))
    return criteria.select("id").join(able.select("id", F.col("first").alias("controller")), "id", "left")


def repeated_names(names: DataFrame) -> DataFrame:
    """names(name) of parameters in use and of parts that occur twice: name, n."""
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def experiments(parameters: DataFrame) -> DataFrame:
    """parameters(system, name, value): start_time, stop_time, output_interval and how many of the last two are declared defaults."""
    wide = parameters.groupBy("system").agg(*(F.min(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("start_time", "stop_time", "output_interval")))
    stop = F.coalesce("stop_time", F.lit(STOP_TIME))
    every = F.coalesce("output_interval", (stop - F.coalesce("start_time", F.lit(0.0))) / INTERVALS)
    return wide.select("system", "start_time", stop.alias("stop_time"), every.alias("output_interval"), (F.col("stop_time").isNull().cast("int") + F.col("output_interval").isNull().cast("int")).alias("defaults"))


def plural(n: Column, word: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(many))


def descriptions(parts: DataFrame, connections: DataFrame) -> DataFrame:
    """parts(model, kind) and connections(model): what a model is made of, as a sentence: model, text."""
    each = parts.groupBy("model", "kind").agg(F.count("*").alias("n")).groupBy("model")
    kinds = each.agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"])), ", ").alias("kinds"))
    j = kinds.join(connections.groupBy("model").agg(F.count("*").alias("c")), "model", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return j.select("model", F.concat(F.lit("The model holds "), plural(F.col("n"), "part", "parts"), F.lit(" ("), "kinds", F.lit(") joined by "), plural(F.col("c"), "connection", "connections"), F.lit(".")).alias("text"))


def conflict_outcomes(conflicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates(id, value, source_id, rank) of conflicts(id, resolution): each with winner or lost."""
    return candidates.join(conflicts, "id").select("id", "rank", "value", "source_id", F.when(F.col("value") == F.col("resolution"), "winner").otherwise("lost").alias("outcome"))


def question_lines(questions: DataFrame) -> DataFrame:
    """questions(id, text, options, default, answer, affects) as lines of a report: id, line."""
    def listed(column: str, between: str, none: str) -> Column:
        return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.array_join(column, between)).otherwise(none)

    answer = F.coalesce(F.concat(F.lit("answer: "), "answer"), F.lit("unanswered"))
    # The wording and marks of a report's lines, here and below.
    parts = ["- ", F.col("id"), ": ", F.col("text"), " Options: ", listed("options", " / ", "none listed"), "; default if unanswered: ", F.coalesce("default", F.lit("none stated")), "; ", answer, ". Affects: ", listed("affects", ", ", "—"), "."]
    return questions.select("id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line"))


def unread_lines(sources: DataFrame) -> DataFrame:
    """sources(path, status, reason) that were not read in full, as lines: path, line."""
    return sources.where("status <> 'read'").select("path", F.concat(F.lit("- "), "status", F.lit(": `"), "path", F.lit("` — "), F.coalesce(F.nullif("reason", F.lit("")), F.lit("no reason given"))).alias("line"))


def declared_defaults(lines: DataFrame) -> DataFrame:
    """The defaults that a generated text declares in comments, of lines(key, n, line): key, n, note."""
    note = F.regexp_extract("line", r"//\s*ASSUMPTION \(generator default\):\s*(.*)$", 1)
    return lines.where(F.col("line").rlike(r"//\s*ASSUMPTION \(generator default\):")).select("key", "n", note.alias("note"))


def summary_lines(parts: DataFrame, connections: DataFrame) -> DataFrame:
    """What a repair is told of a design: parts(id, kind, class) and connections(id, from_port, to_port) as lines: section, id, line."""
    a = parts.select(F.lit(1).alias("section"), "id", F.concat(F.lit("  "), "id", F.lit(" ("), "kind", F.lit(") -> "), F.coalesce("class", F.lit("generated controller"))).alias("line"))
    return a.union(connections.select(F.lit(2), "id", F.concat(F.lit("  "), "id", F.lit(": "), "from_port", F.lit(" -> "), "to_port"))).withColumn("section", F.col("section").cast("int"))
