"""From fragments to a model: labels, owners, parts, connections, sources, criteria and state machines, with what was dropped and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import make_id, mentions, name_key
from proofline.functions.units import to_si
from proofline.operators.graph import components
from proofline.operators.precedence import rank_of
from proofline.operators.skew import numbered
from proofline.storage import materialise

# The order in which roles are read; headers that name a row's quantity, best first; domains of signals.
ROLE_ORDER = (
    "register requirement_spec design_note review_decision change_record datasheet verification_procedure reference_data "
    "legacy_model legacy_architecture correspondence informal_note other"
).split()
LABELS = ["parameter", "keyparameter", "quantity", "description", "name", "input"]
SIGNALS = ["signal_real", "signal_bool", "event"]
SIMILAR_CONFIDENCE = 0.7


def _place(values: list[str], value: Column) -> Column:
    """1, 2, ... of a value in a list; null if it is not there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), value), F.lit(0))


def pass_order(sources: DataFrame) -> DataFrame:
    """sources(source_id, role, status) that were read at all, with place: their role's; a sink orders by place, then id."""
    return sources.where("status <> 'unread'").withColumn("place", F.coalesce(_place(ROLE_ORDER, F.col("role")), F.lit(len(ROLE_ORDER) + 1)))


def sheet_role(headers: Column) -> Column:
    """The role that a table's column headers tell, or null; a list of files with reliabilities tells none."""
    keys = F.transform(headers, lambda h: F.rtrim(F.lower(h), F.lit("'")))

    def some(word: str) -> Column:
        return F.exists(keys, lambda k: k.contains(word))

    def has(*names: str) -> Column:
        return F.arrays_overlap(keys, F.array(*map(F.lit, names)))

    change = some("change summary") | (has("record") & some("summary"))
    return (
        F.when(some("file") & some("reliab"), None).when(change, "change_record")
        .when(has("test id") | some("acceptance criteri"), "verification_procedure").when(has("req id", "requirement id"), "requirement_spec")
    )


def row_labels(rows: DataFrame) -> DataFrame:
    """rows(row, fields array of (k, v)): the quantity that a row's best label column names, if the row has a value column: row, label."""
    each = rows.select("row", F.posexplode("fields").alias("i", "f")).select("row", "i", name_key(F.col("f.k")).alias("key"), F.col("f.v").alias("v"))
    last = each.groupBy("row", "key").agg(F.max_by("v", "i").alias("v")).withColumn("stated", name_key(F.col("v")) != "")
    place = F.when(F.col("stated"), _place(LABELS, F.col("key")))
    told = last.groupBy("row").agg(F.bool_or(F.col("key").startswith("value") | (F.col("key") == "inputvalue")).alias("valued"), F.min_by(F.trim("v"), place).alias("label"))
    return told.where("valued and label is not null").select("row", "label")


def named_by_row(fragments: DataFrame, labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """`fragments(row, name)` named after their row's label, unless catalogue(name) has their name."""
    known = catalogue.select("name", F.lit(True).alias("known")).distinct()
    j = fragments.join(labels, "row", "left").join(known, "name", "left")
    new = F.when(F.col("known").isNull(), make_id(F.lit("param"), F.col("label")))
    return j.withColumn("name", F.coalesce(new, "name")).select(*fragments.columns)


def usable_tag(tag: Column) -> Column:
    """A tag without the spaces around it; null if it has no letter or digit."""
    return F.when(name_key(tag) != "", F.trim(tag))


def iso_or_none(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)


def time_units(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """`rows` with is_time: their unit is a time; no unit is not judged."""
    found = to_si(rows.withColumn("__one", F.lit(1.0)), "__one", unit)
    return found.withColumn("is_time", F.col(unit).isNull() | F.coalesce(F.col("si_unit") == "s", F.lit(False))).drop("__one", "si_value", "si_unit")


def legal_new_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """`rows(kind, value)` with legal: the value is an identifier as it stands, and taken(id) does not have it."""
    held = taken.select(F.col("id").alias("value"), F.lit(True).alias("held")).distinct()
    plain = F.coalesce(make_id(F.col("kind"), F.col("value")) == F.col("value"), F.lit(False))
    return rows.join(held, "value", "left").withColumn("legal", plain & F.col("held").isNull()).select(*rows.columns, "legal")


def index_rows(sources: DataFrame, index: DataFrame) -> DataFrame:
    """`sources(path)` with the row of the source index(file, ord, ...) that has their file name in any case; the last one counts."""
    rest = [c for c in index.columns if c not in ("file", "ord")]
    last = index.groupBy(F.lower("file").alias("__file")).agg(F.max_by(F.struct(*rest), "ord").alias("__row"))
    return sources.withColumn("__file", F.lower(F.regexp_extract("path", "([^/]*)$", 1))).join(last, "__file", "left").select(*sources.columns, *(F.col(f"__row.{c}").alias(c) for c in rest))


def owners(parameters: DataFrame, names: DataFrame) -> DataFrame:
    """`parameters(owner_tag)` with owner, by names(key, part): no tag means the system; problem: the tag names no part."""
    tag = usable_tag(F.col("owner_tag"))
    j = parameters.withColumn("__tag", tag).withColumn("key", name_key(F.col("__tag"))).join(names, "key", "left")
    return j.select(*parameters.columns, F.when(F.col("__tag").isNull(), "system").otherwise(F.col("part")).alias("owner"), (F.col("__tag").isNotNull() & F.col("part").isNull()).alias("problem"))


def end_ports(ports: Column, sending: bool, role: Column) -> Column:
    """Ports (an array of role, direction, domain) that can send, or receive; only the stated role if it is among them."""
    able = F.filter(ports, lambda p: p["direction"].isin("inout", "out" if sending else "in"))
    stated = F.filter(able, lambda p: p["role"] == role)
    return F.when(F.size(stated) > 0, stated).otherwise(able)


def resolve_connections(fragments: DataFrame, names: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connections between ports, and problems: what each fragment says about two tags, settled against the parts' kinds.

    fragments(ord, chunk, tag, from_tag, from_role, to_tag, to_role, medium, signal); names(key, part); parts(part, dynamic,
    alias, ports), ports as in end_ports(). A dynamic part (a controller) has no ports of its own: it gets one for each
    signal port that it is joined to, named after the other part's alias, else the signal, else the part; the first fragment
    decides. Connections(id, from_port, to_port, medium, traces) with the same ends are one; problems(ord, chunk, reason).
    """
    known = names.select("key", "part").join(parts.select("part", "dynamic", "alias", "ports"), "part", "left")  # so fragments, the most rows, meet one table an end
    j = fragments.withColumns({"__a": name_key(F.col("from_tag")), "__b": name_key(F.col("to_tag"))}).drop("from_tag", "to_tag")
    for s in "ab":
        end = known.select(F.col("key").alias(f"__{s}"), *(F.col(c).alias(f"{s}_{c}") for c in ("part", "dynamic", "alias", "ports")))
        j = j.join(end, f"__{s}", "left").drop(f"__{s}")
    j = j.withColumns({"a": end_ports(F.col("a_ports"), True, F.col("from_role")), "b": end_ports(F.col("b_ports"), False, F.col("to_role"))})
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: y["domain"] == x["domain"]), lambda y: F.struct(x["role"].alias("a"), y["role"].alias("b")))))
    forward = ~F.col("a_dynamic")  # the part with ports of its own sends
    signals = F.filter(F.when(forward, F.col("a")).otherwise(F.col("b")), lambda p: p["domain"].isin(SIGNALS))
    j = j.withColumns({"pairs": pairs, "signals": signals, "both": F.col("a_dynamic") & F.col("b_dynamic"), "none": ~F.col("a_dynamic") & ~F.col("b_dynamic")})
    reason = (
        F.when(F.col("a_part").isNull() | F.col("b_part").isNull(), "not a known part").when(F.col("a_part") == F.col("b_part"), "both ends are the same part")
        .when(F.col("both"), "both ends have connection-defined ports")
        .when(F.col("none") & (F.size("pairs") == 0), "no port pair with matching domains").when(F.col("none") & (F.size("pairs") > 1), "ambiguous ports")
        .when(~F.col("none") & (F.size("signals") == 0), "no signal port").when(~F.col("none") & (F.size("signals") > 1), "ambiguous ports")
    )
    j = j.withColumn("reason", reason)
    own, other = (F.when(forward, F.col(f"{x}_part")).otherwise(F.col(f"{y}_part")) for x, y in ("ab", "ba"))
    one = F.col("signals")[0]
    alias, ports = F.when(forward, F.col("a_alias")).otherwise(F.col("b_alias")), F.when(forward, F.col("a_ports")).otherwise(F.col("b_ports"))
    facing = F.size(F.filter(ports, lambda p: p["domain"].isin(SIGNALS) & p["direction"].isin("inout", one["direction"])))
    told = F.when(facing <= 1, alias).otherwise(F.concat_ws(" ", alias, F.when(alias.isNotNull(), one["role"])))

    def port(part: str, role: Column) -> Column:
        return F.concat_ws("_", F.col(part), role)

    good, fixed_, led = F.col("reason").isNull(), F.col("reason").isNull() & F.col("none"), F.col("reason").isNull() & ~F.col("none")
    rest = {"tag": (good, F.col("tag")), "medium": (good, F.col("medium")), "from_port": (fixed_, port("a_part", F.col("pairs")[0]["a"])), "to_port": (fixed_, port("b_part", F.col("pairs")[0]["b"]))}
    rest |= {"forward": (led, forward), "own": (led, own), "controller": (led, other), "role": (led, one["role"]), "domain": (led, one["domain"]), "told": (led, told), "signal": (led, F.col("signal"))}
    j = materialise(j.select("ord", "chunk", "reason", "none", *(F.when(where, c).alias(n) for n, (where, c) in rest.items())), "fragments")  # read by all that follows

    fixed = j.where("reason is null and none").select("ord", "chunk", "tag", "medium", "from_port", "to_port")
    d = j.where("reason is null and not none")
    name = F.coalesce("told", F.when(name_key(F.col("signal")) != "", F.col("signal")), "own")
    d = d.select("ord", "chunk", "tag", "medium", "forward", F.concat_ws("_", "own", "role").alias("static"), "controller", "domain", F.nullif(name, F.lit("")).alias("name"))
    first = d.groupBy("static", "controller").agg(F.min_by("name", "ord").alias("name"))
    d = d.drop("name").join(first, ["static", "controller"]).withColumn("port", F.concat_ws("_", "controller", make_id(F.lit("port"), F.col("name"))))
    facts = d.groupBy("port").agg(F.min_by(F.struct("forward", "domain"), "ord").alias("fact"))
    d = d.join(facts, "port").withColumn("clash", (F.col("fact.forward") != F.col("forward")) | (F.col("fact.domain") != F.col("domain")))
    ends = (F.when(F.col("forward") == first_, F.col("static")).otherwise(F.col("port")).alias(n) for first_, n in ((True, "from_port"), (False, "to_port")))
    good = fixed.unionByName(d.where("not clash").select("ord", "chunk", "tag", "medium", *ends))
    problems = j.where("reason is not null").select("ord", "chunk", "reason").union(d.where("clash").select("ord", "chunk", F.lit("the port already has another direction or domain")))
    merged = good.groupBy("from_port", "to_port").agg(F.min("ord").alias("ord"), F.min_by("tag", "ord").alias("tag"), F.min_by("medium", "ord").alias("medium"), F.array_sort(F.collect_set("chunk")).alias("traces"))
    merged = merged.withColumn("base", make_id(F.lit("conn"), F.col("tag")))
    holder = merged.where("base is not null").groupBy("base").agg(F.min("ord").alias("holder"))
    named = merged.join(holder, "base", "left").withColumn("id", F.when(F.col("holder") == F.col("ord"), F.col("base")).otherwise(F.concat_ws("_to_", "from_port", "to_port")))
    return named.select("id", "from_port", "to_port", "medium", "traces"), problems


def merge_similar(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names(entity, kind, name): entities of one kind whose names share letter and number, and no third one does, become one.

    Returns merged(entity, kept) for entities that are in such a pair, and assumptions(entity, name_a, name_b, confidence).
    Entities that are both known by formal tags never merge.
    """
    key = name_key(F.col("name"))
    sig = F.concat(F.regexp_extract(key, "^([a-z])[a-z]*([0-9]+)$", 1), F.regexp_extract(key, "^([a-z])[a-z]*([0-9]+)$", 2))
    formal = F.col("name").rlike("^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")
    tagged = names.groupBy("entity").agg(F.bool_or(formal).alias("tagged"))
    held = names.withColumn("signature", sig).where("signature <> ''").groupBy("kind", "signature", "entity").agg(F.min("name").alias("name")).join(tagged, "entity")
    both = held.groupBy("kind", "signature").agg(F.count("*").alias("n"), F.min(F.struct("entity", "name", "tagged")).alias("a"), F.max(F.struct("entity", "name", "tagged")).alias("b"))
    pairs = both.where("n = 2 and not (a.tagged and b.tagged)")
    merged = components(pairs.select(F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).distinct()).select(F.col("node").alias("entity"), F.col("root").alias("kept"))
    told = pairs.select(F.col("a.entity").alias("entity"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.lit(SIMILAR_CONFIDENCE).alias("confidence"))
    return merged, told


def assemble_parts(fragments: DataFrame, kinds: DataFrame) -> DataFrame:
    """Parts from fragments(entity, name, tag, rank, ord, source, locator) and the elected kinds(entity, kind): id, kind, name, tags, traces.

    The best-ranked formal tag is canonical, else the best-ranked tag; it makes the id, with the kind behind it where another
    part already has that id. The name is the best-ranked one that is stated, else the tag. Entities of unknown kind are no parts.
    """
    formal = F.col("tag").rlike("^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")
    each = fragments.groupBy("entity").agg(
        F.min_by("tag", F.struct((~formal).alias("informal"), "rank", "ord")).alias("tag"), F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("rank", "ord"))).alias("name"),
        F.array_sort(F.collect_set("tag")).alias("all_tags"), F.array_sort(F.collect_set(F.concat_ws(" ", "source", "locator"))).alias("traces"),
    )
    known = each.join(kinds.where("kind <> 'unknown'"), "entity").withColumn("base", make_id(F.col("kind"), F.col("tag")))
    holder = known.groupBy("base").agg(F.min("entity").alias("holder"))
    id_ = F.when(F.col("holder") == F.col("entity"), F.col("base")).otherwise(make_id(F.col("kind"), F.concat_ws(" ", "tag", "kind")))
    tags = F.concat(F.array("tag"), F.array_remove("all_tags", F.col("tag")))
    return known.join(holder, "base").select("entity", id_.alias("id"), "kind", F.coalesce("name", "tag").alias("name"), tags.alias("tags"), "traces")


def part_ports(parts: DataFrame, kind_ports: DataFrame) -> DataFrame:
    """The ports that a part has from its kind: id, part, role, direction, domain. Kinds without rows (controllers) give none."""
    return parts.select(F.col("id").alias("part"), "kind").join(kind_ports, "kind").select(F.concat_ws("_", "part", "role").alias("id"), "part", "role", "direction", "domain")


def system_names(parts: DataFrame, system_name: str) -> DataFrame:
    """parts(id, kind, tags) that only name the system: all their tags stand in its name, and another part has their kind."""
    by_kind = parts.groupBy("kind").agg(F.count("*").alias("n"))
    only = F.coalesce(F.forall("tags", lambda t: mentions(F.lit(system_name), t)), F.lit(False)) & (F.size("tags") > 0)
    return parts.where(only).join(by_kind, "kind").where("n > 1").select("id", "kind")


def source_names(sources: DataFrame) -> DataFrame:
    """sources(source_id, document) with id: the document's number where one is stated and no earlier source has it, else their own."""
    keyed = sources.withColumn("base", make_id(F.lit("src"), F.col("document")))
    holder = keyed.where("base is not null").groupBy("base").agg(F.min("source_id").alias("holder"))
    own = F.when(F.col("holder") == F.col("source_id"), F.col("base")).otherwise(make_id(F.lit("src"), F.col("source_id").cast("string")))
    return keyed.join(holder, "base", "left").select("source_id", own.alias("id"))


def candidates(fragments: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate values of parameters, and problems, from fragments(ord, owner, name, value, unit, cited, role, date, provisional).

    value is a number or null where the text was none. documents(key, role, date, approved) are what a fragment can cite: then
    their role, date and approval count. A candidate has its SI value and unit, its rank, and whether it is provisional.
    """
    known = documents.select(F.col("key").alias("cited"), F.col("role").alias("d_role"), F.col("date").alias("d_date"), "approved", F.lit(True).alias("found"))
    j = to_si(fragments, "value", "unit").join(known, "cited", "left")
    approved = F.coalesce("approved", F.lit(True))
    role = F.when(F.col("found"), F.col("d_role")).otherwise(F.col("role"))
    reason = F.when(name_key(F.col("name")) == "", "the name has no letters or digits").when(F.col("value").isNull(), "not a number").when(F.col("si_unit").isNull() & F.col("unit").isNotNull(), "unknown unit")
    j = j.withColumns({"reason": reason, "__role": role, "__approved": approved})
    good = j.where("reason is null").select(
        "ord", "owner", make_id(F.lit("param"), F.col("name")).alias("name"), "si_value", "si_unit", rank_of(F.col("__role"), F.col("__approved")).alias("rank"),
        iso_or_none(F.when(F.col("found"), F.col("d_date")).otherwise(F.col("date"))).alias("date"), (F.coalesce("provisional", F.lit(False)) | ((F.col("__role") == "change_record") & ~F.col("__approved"))).alias("provisional"),
    )
    problems = j.where("reason is not null").select("ord", "reason").union(j.where("reason is null and cited is not null and found is null").select("ord", F.lit("the cited document is not known")))
    return good, problems


def missing_documents(sources: DataFrame, unresolved: DataFrame) -> DataFrame:
    """What is cited but not there: sources(id, path) without a file, and unresolved(tag): name, why."""
    a = sources.where("path is null").select(F.col("id").cast("string").alias("name"), F.lit("cited, but not in the bundle").alias("why"))
    return a.union(unresolved.select(F.col("tag").cast("string"), F.lit("neither contained nor described")).distinct())


def merge_criteria(rows: DataFrame) -> DataFrame:
    """rows(tag, chunk, rank, ord, text) to criteria(id, tag, text, traces): one per usable tag, else per chunk; the best rank's text."""
    tag = usable_tag(F.col("tag"))
    id_ = F.coalesce(make_id(F.lit("ac"), tag), F.concat(F.lit("ac_"), F.col("chunk").cast("string")))
    return rows.withColumns({"id": id_, "tag": tag}).groupBy("id").agg(F.min_by("tag", F.struct("rank", "ord")).alias("tag"), F.min_by("text", F.struct("rank", "ord")).alias("text"), F.array_sort(F.collect_set("chunk")).alias("traces"))


def criteria_checks(criteria: DataFrame, checks: DataFrame) -> DataFrame:
    """`criteria(id, tags)` with the first of checks(tag, ord, check) whose tag is one of theirs, as names are compared."""
    own = criteria.select("id", F.explode("tags").alias("tag")).select("id", name_key(F.col("tag")).alias("key")).distinct()
    hit = own.join(checks.select(name_key(F.col("tag")).alias("key"), "ord", "check"), "key").groupBy("id").agg(F.min_by("check", "ord").alias("check"))
    return criteria.join(hit, "id", "left")


def invariants(criteria: DataFrame) -> DataFrame:
    """Criteria that must hold for the whole run: mode `always` without bounds."""
    return criteria.where("mode = 'always' and start_s is null and end_s is null")


def assemble_transitions(transitions: DataFrame, states: DataFrame, events: DataFrame, precedence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A machine's transitions level by level: kept, dropped with the reason, and collisions of priority.

    transitions(machine, id, from_state, to_state, trigger, priority, except_states); states(machine, state); events(machine,
    trigger); precedence(machine, trigger, place): the stated order of commands. `*` stands for every state but the excepted
    ones and the target. Of those that share a state and a place the first (by id) is kept, the others collide. Where a
    precedence is stated, commands go in its order, then other commands, then guards, numbered anew from 1; else the stated
    numbers hold. A transition to `history` is kept.
    """
    star = transitions.where("from_state = '*'").withColumnRenamed("from_state", "__star").join(states.withColumnRenamed("state", "from_state"), "machine")
    star = star.where(~F.coalesce(F.array_contains("except_states", F.col("from_state")), F.lit(False)) & (F.col("from_state") != F.col("to_state")))
    every = transitions.where("from_state <> '*'").unionByName(star.select(*transitions.columns))
    flag = F.lit(True)
    j = every.join(states.select("machine", F.col("state").alias("from_state"), flag.alias("has_from")).distinct(), ["machine", "from_state"], "left")
    j = j.join(states.select("machine", F.col("state").alias("to_state"), flag.alias("has_to")).distinct(), ["machine", "to_state"], "left")
    j = j.join(events.select("machine", "trigger", flag.alias("has_event")).distinct(), ["machine", "trigger"], "left")
    reason = (
        F.when(F.col("has_from").isNull(), "from no kept state").when(F.col("has_to").isNull() & (F.col("to_state") != "history"), "to no kept state")
        .when(F.col("trigger").isNotNull() & F.col("has_event").isNull(), "no kept event")
    )
    j = j.withColumn("reason", reason)
    ranked = precedence.select("machine", flag.alias("ranked")).distinct()
    ok = j.where("reason is null").join(precedence.select("machine", "trigger", "place"), ["machine", "trigger"], "left").join(ranked, "machine", "left")
    level = F.when(F.col("ranked").isNull(), 0).when(F.col("place").isNotNull(), 0).when(F.col("trigger").isNotNull(), 1).otherwise(2)
    ok = ok.withColumn("o", F.struct(level.alias("level"), F.coalesce("place", "priority").cast("long").alias("n")))
    first = ok.groupBy("machine", "from_state", "o").agg(F.min("id").alias("kept"))
    ok = ok.join(first, ["machine", "from_state", "o"])
    kept = ok.where("id = kept").withColumn("r", F.row_number().over(Window.partitionBy("machine", "from_state").orderBy("o")))
    kept = kept.select("machine", "id", "from_state", "to_state", "trigger", F.when(F.col("ranked"), F.col("r")).otherwise(F.col("priority")).cast("int").alias("priority"))
    collisions = ok.where("id <> kept").select("machine", "from_state", "kept", F.col("id").alias("dropped"))
    dropped = j.where("reason is not null").select("machine", "id", "from_state", "reason").union(collisions.select("machine", F.col("dropped").alias("id"), "from_state", F.lit("the priority is taken").alias("reason")))
    return kept, dropped, collisions


def collision_questions(collisions: DataFrame) -> DataFrame:
    """collisions(machine, from_state, kept, dropped): one question a pair, with every state where it clashes."""
    return collisions.groupBy("machine", "kept", "dropped").agg(F.array_sort(F.collect_set("from_state")).alias("states"))


def timer_owners(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(machine, state, timer): timers that count in a state: started by its entry actions, or by a transition into it.

    Both have actions, an array such as `start_timer(t1)`; a return to history starts none.
    """
    a = states.select("machine", "state", F.explode("actions").alias("action"))
    b = transitions.where("to_state <> 'history'").select("machine", F.col("to_state").alias("state"), F.explode("actions").alias("action"))
    timer = F.regexp_extract("action", r"^\s*start_timer\(\s*(\w+)\s*\)\s*$", 1)
    return a.union(b).withColumn("timer", timer).where("timer <> ''").select("machine", "state", "timer").distinct()


def frozen_timers(owned: DataFrame, states: DataFrame, transitions: DataFrame) -> DataFrame:
    """Timers of owned(machine, state, timer) that run in a state that saves history."""
    saving = states.where(F.array_contains("actions", "save_history")).select("machine", "state").union(transitions.where(F.array_contains("actions", "save_history")).select("machine", F.col("from_state").alias("state")))
    return owned.join(saving.distinct(), ["machine", "state"], "left_semi").select("machine", "timer").distinct()


def united(passes: list[DataFrame], order: str) -> DataFrame:
    """What several passes over the sources found as one table: its columns are those of all passes (null where a pass has none),
    with `pass` from 0 and `ord`, which numbers all rows pass by pass in each pass's own order."""
    each = [d.withColumnRenamed(order, "__order").withColumn("pass", F.lit(n)) for n, d in enumerate(passes)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    return numbered(every, ["pass", "__order"], "ord").drop("__order")
