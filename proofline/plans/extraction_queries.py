"""Queries on entities, schedules, machines and rendered texts."""

from pyspark.sql import functions as F

from proofline.operators import entities, machines, render, schedule
from proofline.plans.registry import query


@query("""select p_partkey, case when p_size % 2 = 0 then [p_name, 'AB-' || p_size, p_type] else ['AB-' || p_size, p_name] end as names from part""")
def linked_names(t):
    names = F.when(F.col("p_size") % 2 == 0, F.array("p_name", F.concat(F.lit("AB-"), F.col("p_size").cast("string")), "p_type")).otherwise(F.array(F.concat(F.lit("AB-"), F.col("p_size").cast("string")), F.lit("CD-1"), F.col("p_name")))
    return t.part.select("p_partkey", entities.linked_names(names).alias("names"))


@query("""with n as (select o_custkey entity, case when o_orderkey % 4 = 0 then 'AB-' || o_orderkey else 'order ' || o_orderkey end as name, o_orderpriority "rank", o_orderkey ord from orders)
          select entity, arg_min(name, (not regexp_matches(name, '^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$'), "rank", ord)) as tag from n group by entity""")
def canonical_tags(t):
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("AB-"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return entities.canonical(t.orders.select(F.col("o_custkey").alias("entity"), name.alias("name"), F.col("o_orderpriority").alias("rank"), F.col("o_orderkey").alias("ord")))


@query("""with f as (select o_custkey entity, o_orderstatus k, arg_min(cast(o_orderkey as varchar), (o_orderpriority, o_orderkey)) v from orders group by 1, 2) select entity, string_agg(k || '=' || v, ';' order by k) as attributes from f group by 1""")
def entity_attributes(t):
    rows = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderpriority").alias("rank"), F.col("o_orderkey").alias("ord"))
    return entities.attributes(rows).select("entity", F.array_join(F.transform("attributes", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ";").alias("attributes"))


@query("""select l_partkey as entity, count(distinct (l_suppkey, l_returnflag, l_linestatus)) as traces from lineitem group by 1""")
def entity_traces(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_returnflag").alias("locator"), F.col("l_linestatus").alias("quote"))
    return entities.traces(rows).select("entity", F.size("trace").cast("long").alias("traces"))


@query("""with e as (select l_partkey k, l_suppkey a, min(l_orderkey * 10 + l_linenumber) seen, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) tag from lineitem group by 1, 2) select k as key, arg_min(tag, seen) as tag, string_agg(cast(a as varchar), ',' order by seen, cast(a as varchar)) as aliases from e group by k""")
def glossary_terms(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("kind"), F.col("l_suppkey").cast("string").alias("alias"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return entities.glossary(rows).select("key", "tag", F.array_join("aliases", ",").alias("aliases"))


@query("""select c_custkey as key, c_name as title, false as absent from customer where c_acctbal > 0 union all select o_custkey, min('cited ' || o_custkey), true from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 1""")
def document_registry(t):
    stated = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_custkey").alias("ord"))
    return entities.registry(stated, t.orders.select(F.col("o_custkey").alias("key"), F.concat(F.lit("cited "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderkey").alias("ord")))


@query("""select o_orderkey as id, case when o_custkey in (select c_custkey from customer where c_acctbal > 0) then 'doc' || o_custkey end as document from orders""")
def cited_documents(t):
    key = F.concat(F.lit("doc"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "reva").otherwise(""))
    known = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("doc"), F.col("c_custkey").cast("string")).alias("key"))
    return entities.cited_document(t.orders.select(F.col("o_orderkey").alias("id"), key.alias("key")), known).select("id", "document")


@query("""select o_orderkey, case when n = 1 then b else b || '_' || n end as free_id from (select o_orderkey, o_custkey || o_orderstatus b, row_number() over (partition by o_custkey || o_orderstatus order by o_orderkey) n from orders)""")
def free_ids(t):
    rows = t.orders.select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), "o_orderstatus").alias("base"))
    return entities.free_ids(rows, "base", "o_orderkey").select("o_orderkey", "free_id")


@query("""with h as (select p_partkey i, count(distinct s_suppkey) n, min(s_suppkey) part from part join supplier on s_nationkey = p_size and s_nationkey % 2 = p_partkey % 2 group by 1)
          select p_partkey as input, case when coalesce(n, 0) = 1 then 'link' when coalesce(n, 0) > 1 then 'question' else 'missing' end as outcome, case when n = 1 then part end as part from part left join h on i = p_partkey""")
def measured_parts(t):
    inputs = t.part.select(F.col("p_partkey").alias("input"), (F.col("p_partkey") % 2).alias("kind"), F.concat(F.lit("reads site_"), F.col("p_size").cast("string"), F.lit(" daily")).alias("text"))
    parts = t.supplier.select(F.col("s_suppkey").alias("part"), (F.col("s_nationkey") % 2).alias("kind"), F.concat(F.lit("site_"), F.col("s_nationkey").cast("string")).alias("name"))
    return entities.measured_part(inputs, parts)


@query("""select p_brand as "table", case when max(p_size) > 45 then 'size' end as header from part group by 1""")
def schedule_value_columns(t):
    cells = t.part.groupBy("p_brand").agg(F.max("p_size").alias("m")).join(t.part, "p_brand").select(F.col("p_brand").alias("table"), F.explode(F.array(F.struct(F.lit("start time").alias("h"), F.lit("1").alias("c")), F.struct(F.lit("size").alias("h"), F.when(F.col("m") > 45, F.col("p_size").cast("string")).otherwise("n/a").alias("c")), F.struct(F.lit("note").alias("h"), F.col("p_name").alias("c")))).alias("x"))
    return schedule.value_column(cells.select("table", F.col("x.h").alias("header"), F.col("x.c").alias("cell")))


PRESSED = """with p as (select 'B' || l_suppkey control, l_returnflag source, list_sort(list(distinct cast(l_quantity as double))) times from lineitem group by 1, 2)"""


def _pressed(t):
    button, when = F.concat(F.lit("BUTTON"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string")
    prose = F.concat(F.lit("Press PB-"), button, F.lit("  at "), when, F.lit(" s, then wait; "), button, F.lit(" is left at 900 s."))
    table = F.concat(F.lit("time [s]\n"), when, F.lit("\n "), button, F.lit(" \n7 s\nother"))
    text = F.when(F.col("l_linenumber") % 2 == 0, table).otherwise(prose)
    texts = t.lineitem.select(F.col("l_returnflag").alias("source"), text.alias("text"))
    return schedule.press_times(texts, t.supplier.select(F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("control"), F.concat(F.lit("button"), F.col("s_suppkey").cast("string")).alias("name")))


@query(PRESSED + " select * from p")
def press_times(t):
    return _pressed(t)


@query("""select 'B' || l_suppkey as control, l_returnflag || l_linestatus as source, list(distinct cast(l_quantity as double) order by cast(l_quantity as double)) as times from lineitem where l_suppkey in (select s_suppkey from supplier) group by 1, 2""")
def press_times_of_rows(t):
    fields = F.create_map(F.lit("Time [s]"), F.col("l_quantity").cast("string"), F.lit("Control"), F.concat(F.lit(" BUTTON"), F.col("l_suppkey").cast("string")), F.lit("Line"), F.col("l_linenumber").cast("string"))
    texts = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("source"), F.array_join(F.map_values(fields), " | ").alias("text"), fields.alias("fields"))
    k = F.col("s_suppkey").cast("string")
    return schedule.press_times(texts, t.supplier.select(F.concat(F.lit("B"), k).alias("control"), F.concat(F.lit("button"), k).alias("name")), "fields")


@query(PRESSED + " select control, count(*) as sources, case when count(distinct times) = 1 then min(times) end as times from p group by 1")
def press_schedules(t):
    return schedule.agreed_schedules(_pressed(t))


@query("""with a as (select distinct l_partkey part, l_orderkey id from lineitem where l_quantity > 40), b as (select o_custkey tab, o_orderkey id from orders where o_orderstatus = 'P'), h as (select part, count(distinct tab) n, min(tab) tab from a join b using (id) group by 1), p as (select distinct part from a)
          select p.part, coalesce(n, 0) as tables, case when n = 1 then tab end as "table" from p left join h on h.part = p.part""")
def schedule_tables(t):
    parts = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set("l_orderkey").alias("cited"))
    tables = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("table")).agg(F.collect_set("o_orderkey").alias("named"))
    return schedule.tables_of_parts(parts, tables)


def _machine(t):
    e = t.events
    states = e.select(F.col("user_id").alias("machine"), F.col("event_type").alias("state")).distinct()
    moves = e.select(F.col("user_id").alias("machine"), F.col("event_id").alias("id"), F.when(F.col("value") > 60, "*").otherwise(F.col("event_type")).alias("from_state"), F.when(F.col("value") < 3, "nowhere").otherwise("click").alias("to_state"), F.when(F.col("event_id") % 5 == 0, "bad").otherwise("go").alias("trigger"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("priority"))
    return states, moves


MACHINE = """with s as (select distinct user_id machine, event_type state from events), m as (select user_id machine, event_id id, case when value > 60 then '*' else event_type end f, case when value < 3 then 'nowhere' else 'click' end g, case when event_id % 5 = 0 then 'bad' else 'go' end tr, case when event_id % 3 = 0 then event_id % 7 end p from events),
    x as (select * from m where f <> '*' union all select m.machine, m.id, s.state, m.g, m.tr, m.p from m join s on s.machine = m.machine where m.f = '*' and s.state <> m.g and not exists (select 1 from m o where o.machine = m.machine and o.tr = m.tr and o.f = s.state)),
    r as (select x.*, case when not exists (select 1 from s where s.machine = x.machine and s.state = x.f) then 'unknown source state' when not exists (select 1 from s where s.machine = x.machine and s.state = x.g) then 'unknown target state' when tr = 'bad' then 'unknown trigger' end reason from x)"""


@query(MACHINE + " select machine, id, f as from_state, g as to_state, reason from r")
def machine_transitions(t):
    states, moves = _machine(t)
    triggers = states.select("machine").distinct().withColumn("trigger", F.lit("go"))
    return machines.check_transitions(machines.expand_any_state(moves, states), states, triggers).select("machine", "id", "from_state", "to_state", "reason")


@query(MACHINE + " select machine, id, f as from_state, cast(row_number() over (partition by machine, f order by p nulls last, id) as int) as priority from x where f <> 'nowhere'")
def transition_priorities(t):
    states, moves = _machine(t)
    return machines.renumber(machines.expand_any_state(moves, states)).select("machine", "id", "from_state", "priority")


@query("""with s as (select distinct user_id machine, event_type state from events), v as (select user_id machine, event_type state, bool_or(value > 50) tr from events where value > 5 group by 1, 2), g as (select s.machine, s.state, v.tr from s left join v on v.machine = s.machine and v.state = s.state)
          select machine, 'valve' as port, coalesce(string_agg(state, ',' order by state) filter (where tr), '') as true_in, count(*) filter (where tr is null) as without_value from g group by 1""")
def state_outputs(t):
    states, _ = _machine(t)
    values = t.events.where("value > 5").groupBy(F.col("user_id").alias("machine"), F.col("event_type").alias("state")).agg(F.bool_or(F.col("value") > 50).alias("truth")).withColumn("port", F.lit("valve"))
    return machines.state_outputs(states, states.select("machine").distinct().withColumn("port", F.lit("valve")), values).select("machine", "port", F.array_join("true_in", ",").alias("true_in"), "without_value")


@query("""select o_custkey as run, arg_min(o_orderkey, (o_orderstatus <> 'F', substr(o_orderpriority, 1, 1), o_orderkey)) as attempt from orders group by 1""")
def best_attempt(t):
    return machines.best_attempt(t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("has_machine"), F.substring("o_orderpriority", 1, 1).alias("discarded")))


def _structure(t):
    parts = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("kind"))
    ports = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("part"), F.lit("outlet").alias("role"), F.lit("out").alias("direction"))
    links = t.lineitem.select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))).alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a_part"), F.lit("outlet").alias("a_role"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b_part"), F.lit("inlet").alias("b_role"))
    return parts, ports, links


@query("""select distinct 1 as section, 'nation ' || s_nationkey as key, '    part def ''nation ' || s_nationkey || ''';' as line from supplier
          union all select 2, 's' || s_suppkey || ' 0', '    part s' || s_suppkey || ' : ''nation ' || s_nationkey || ''' {' from supplier union all select 2, 's' || s_suppkey || ' 1 outlet', '        out port outlet;' from supplier union all select 2, 's' || s_suppkey || ' 2', '    }' from supplier
          union all select 3, l_orderkey || '-' || l_linenumber || '-' || l_partkey, '    connect s' || l_suppkey || '.outlet to p' || l_partkey || '.inlet;' from lineitem""")
def render_structure(t):
    return render.structure_text(*_structure(t))


@query("""select 1 as section, 's' || s_suppkey as key, '  Nation s' || s_suppkey || '(a = ' || s_nationkey || ', b = 1);' as line from supplier union all select 2, l_orderkey || '-' || l_linenumber || '-' || l_partkey, '  connect(s' || l_suppkey || '.outlet, p' || l_partkey || '.inlet);' from lineitem""")
def render_equations(t):
    parts, _, links = _structure(t)
    values = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("owner"), F.explode(F.array(F.struct(F.lit("a").alias("n"), F.col("s_nationkey").alias("v")), F.struct(F.lit("b").alias("n"), F.lit(1).alias("v")))).alias("x")).select("owner", F.col("x.n").alias("name"), F.col("x.v").alias("value"))
    return render.equation_text(parts.withColumn("kind", F.lit("Nation")), values, links)


@query("""select 'part' as keyword, 's' || s_suppkey as name, '''nation ' || s_nationkey || '''' as type, 0 as depth, cast(null as varchar) as owner from supplier union all select 'port', 'outlet', null, 1, 's' || s_suppkey from supplier union all select distinct 'part def', '''nation ' || s_nationkey || '''', null, 0, null from supplier""")
def scan_rendered_structure(t):
    """The rendered text of each part is read back as a source of its own."""
    parts, ports, links = _structure(t)
    text = render.structure_text(parts, ports, links.where("false"))
    lines = text.select(F.when(F.col("section") == 1, F.concat(F.lit("def "), "key")).otherwise(F.regexp_extract("key", "^(\\S+)", 1)).alias("source"), F.col("key").alias("n"), "line")
    return render.scan_structure(lines, "source").select("keyword", "name", "type", F.col("depth").cast("int").alias("depth"), "owner")


@query("""select '  connect' as kind, l_suppkey as s, l_partkey as p, count(*) as n from lineitem group by 2, 3""")
def scan_rendered_equations(t):
    _, _, links = _structure(t)
    text = links.select(F.col("id").alias("source"), F.lit(1).alias("n"), F.concat(F.lit("  connect("), "a_part", F.lit("."), "a_role", F.lit(", "), "b_part", F.lit("."), "b_role", F.lit(");")).alias("line"))
    name = render.scan_equations(text, "source").groupBy("kind", "name").agg(F.count("*").alias("n"))
    return name.select(F.concat(F.lit("  "), "kind").alias("kind"), F.regexp_extract("name", r"^s(\d+)", 1).cast("long").alias("s"), F.regexp_extract("name", r"p(\d+)\.", 1).cast("long").alias("p"), "n")


@query("""select o_orderkey, o_orderstatus as verdict, cast(o_custkey as varchar) as messages, case when o_orderkey % 2 = 0 then cast(o_custkey as double) end as stopped_at from orders""")
def tool_output_fields(t):
    out = F.concat(F.lit("<<verdict>>\n"), "o_orderstatus", F.lit("\n<<messages>>"), F.col("o_custkey").cast("string"), F.lit("\n"))
    log = F.concat(F.lit("assert x at time 1.0\n"), F.col("o_orderkey").cast("string"), F.lit("\nassertion level at time "), F.col("o_custkey").cast("string"))
    fields = render.marked_fields(out, ["verdict", "messages"])
    return t.orders.select("o_orderkey", fields["verdict"].alias("verdict"), fields["messages"].alias("messages"), F.when(F.col("o_orderkey") % 2 == 0, render.assertion_stop(log)).alias("stopped_at"))


@query()
def text_diffs(t):
    return t.documents.select("doc_id", render.unified_diff(F.col("text"), F.replace("text", F.lit(","), F.lit(";"))).alias("diff"))
