"""Queries that assemble a model from fragments, over whole tables."""

from pyspark.sql import functions as F

from proofline.operators import assembly
from proofline.plans.registry import query


def text(column):
    return F.col(column).cast("string")


def role(column):
    """A role for each order priority; one that is in no list."""
    p = F.col(column)
    return F.when(p == "1-URGENT", "register").when(p == "2-HIGH", "datasheet").when(p == "3-MEDIUM", "requirement_spec").when(p == "5-LOW", "change_record").otherwise("sketch")


ROLE = """case o_orderpriority when '1-URGENT' then 'register' when '2-HIGH' then 'datasheet' when '3-MEDIUM' then 'requirement_spec'
          when '5-LOW' then 'change_record' else 'sketch' end"""


@query("""select o_orderkey as source_id, case o_orderpriority when '1-URGENT' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 5
          when '2-HIGH' then 6 else 14 end as place from orders where o_orderstatus <> 'P'""")
def pass_order(t):
    rows = t.orders.select(F.col("o_orderkey").alias("source_id"), role("o_orderpriority").alias("role"), F.when(F.col("o_orderstatus") == "P", "unread").otherwise("read").alias("status"))
    return assembly.pass_order(rows).select("source_id", "place")


@query("""select p_partkey, case when p_size % 2 = 0 and p_size % 3 = 0 then null when p_size % 5 = 0 or (p_size % 7 = 0 and p_size % 3 = 1) then 'change_record'
          when p_size % 11 = 0 then 'verification_procedure' when p_size % 13 = 0 then 'requirement_spec' end as role from part""")
def sheet_roles(t):
    def sometimes(of, rest, header):
        return F.when(F.col("p_size") % of == rest, header).otherwise("plain")

    headers = F.array(F.col("p_type"), sometimes(2, 0, "File name"), sometimes(3, 0, "Reliability"), sometimes(5, 0, "Change Summary'"), sometimes(7, 0, "RECORD"), sometimes(3, 1, "Summary"), sometimes(11, 0, "Test ID'"), sometimes(13, 0, "Requirement ID"))
    return t.part.select("p_partkey", assembly.sheet_role(headers).alias("role"))


def _rows(t):
    key = F.when(F.col("o_orderstatus") == "F", "Value [kg]").when(F.col("o_orderstatus") == "O", "Input-Value").otherwise("note")
    pair = [(key, text("o_totalprice")), (F.lit("Name"), F.concat(F.lit(" name "), text("o_custkey"))), (F.lit("Quantity"), F.when(F.col("o_orderkey") % 3 == 0, "--").otherwise(F.col("o_orderpriority")))]
    return t.orders.select(F.col("o_orderkey").alias("row"), F.array(*(F.struct(k.alias("k"), v.alias("v")) for k, v in pair)).alias("fields"))


@query("""select o_orderkey as row, case when o_orderkey % 3 = 0 then 'name ' || o_custkey else o_orderpriority end as label from orders where o_orderstatus in ('F', 'O')""")
def row_labels(t):
    return assembly.row_labels(_rows(t))


@query("""select o_orderkey as row, case when o_orderkey % 5 = 0 or o_orderstatus = 'P' then 'n' || o_orderkey % 5 when o_orderkey % 3 = 0 then 'name_' || o_custkey
          else 'param_' || replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') end as name from orders""")
def named_by_row(t):
    fragments = t.orders.select(F.col("o_orderkey").alias("row"), F.concat(F.lit("n"), (F.col("o_orderkey") % 5).cast("string")).alias("name"))
    return assembly.named_by_row(fragments, assembly.row_labels(_rows(t)), t.spark.createDataFrame([("n0",)], "name string"))


@query("""select s_suppkey, case when s_suppkey % 3 <> 0 then 'T-' || s_suppkey end as tag, case when s_suppkey % 4 = 0 then '2026-01-02' end as date from supplier""")
def usable_tags_and_dates(t):
    tag = F.when(F.col("s_suppkey") % 3 == 0, " - ").otherwise(F.concat(F.lit(" T-"), text("s_suppkey"), F.lit(" ")))
    date = F.when(F.col("s_suppkey") % 4 == 0, "2026-01-02").when(F.col("s_suppkey") % 4 == 1, "2 January 2026").when(F.col("s_suppkey") % 4 == 2, "2026-01-02T10")
    return t.supplier.select("s_suppkey", assembly.usable_tag(tag).alias("tag"), assembly.iso_or_none(date).alias("date"))


@query("select p_partkey, p_size % 8 in (1, 2, 7) as is_time from part")
def timer_units(t):
    unit = F.get(F.array(*map(F.lit, ("kg", "min", "h", "furlong", "K", "m", "bar", None))), F.col("p_size") % 8)
    return assembly.time_units(t.part.select("p_partkey", unit.alias("unit"))).select("p_partkey", "is_time")


@query("""select p_partkey, p_size % 3 = 0 and p_partkey not in (select l_partkey from lineitem where l_quantity > 45) as legal from part""")
def legal_new_ids(t):
    value = F.concat(F.when(F.col("p_size") % 3 == 0, "s_").when(F.col("p_size") % 3 == 1, "S ").otherwise("9"), text("p_partkey"))
    rows = t.part.select("p_partkey", F.lit("state").alias("kind"), value.alias("value"))
    taken = t.lineitem.where("l_quantity > 45").select(F.concat(F.lit("s_"), text("l_partkey")).alias("id"))
    return assembly.legal_new_ids(rows, taken).select("p_partkey", "legal")


@query("""with i as (select 'file' || s_nationkey f, arg_max(s_name, s_suppkey) title from supplier group by 1)
          select c_custkey, title from customer left join i on f = 'file' || c_nationkey""")
def index_rows(t):
    sources = t.customer.select("c_custkey", F.concat(F.lit("a/b/FILE"), text("c_nationkey")).alias("path"))
    index = t.supplier.select(F.concat(F.lit("File"), text("s_nationkey")).alias("file"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("title"))
    return assembly.index_rows(sources, index).select("c_custkey", "title")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'system' else 'c' || c_custkey end as owner, o_orderkey % 4 <> 0 and c_custkey is null as problem
          from orders left join customer on c_custkey = o_custkey and c_acctbal > 0""")
def owner_lookup(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.concat(F.lit("C-"), text("o_custkey"))).alias("owner_tag"))
    names = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("c"), text("c_custkey")).alias("key"), F.concat(F.lit("c"), text("c_custkey")).alias("part"))
    return assembly.owners(rows, names).select("o_orderkey", "owner", "problem")


# Kinds of the senders (by supplier) and of the receivers (by part) with their ports; the third of each is a controller.
SENDERS = [[("outlet", "out", "fluid"), ("level", "out", "signal_real")], [("outlet", "out", "fluid"), ("drain", "out", "fluid")], []]
RECEIVERS = [[("inlet", "in", "fluid"), ("command", "in", "signal_real")], [("pad", "in", "thermal")], []]


def _ports(kinds, which):
    lists = [F.array(*(F.struct(F.lit(r).alias("role"), F.lit(d).alias("direction"), F.lit(m).alias("domain")) for r, d, m in k)) if k else F.expr("cast(array() as array<struct<role:string,direction:string,domain:string>>)") for k in kinds]
    return F.when(which == 0, lists[0]).when(which == 1, lists[1]).otherwise(lists[2])


def _connections(t):
    def parts(df, letter, key, kind, kinds):
        alias = F.when(F.col(key) % 2 == 0, F.concat(F.lit(letter.upper()), text(key)))
        return df.select(F.concat(F.lit(letter), text(key)).alias("part"), (kind == 2).alias("dynamic"), alias.alias("alias"), _ports(kinds, kind).alias("ports"))

    every = parts(t.supplier.where("s_acctbal > -500"), "s", "s_suppkey", F.col("s_nationkey") % 3, SENDERS).union(parts(t.part, "p", "p_partkey", F.col("p_size") % 3, RECEIVERS))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    from_role = F.when(F.col("l_linenumber") % 2 == 1, "level").when(F.col("l_linenumber") == 2, "drain")
    fragments = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("flag")).select(
        F.struct(line.alias("line"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).alias("ord"), line.alias("chunk"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("C "), text("l_orderkey"))).alias("tag"),
        F.concat(F.lit("S-"), text("l_suppkey")).alias("from_tag"), from_role.alias("from_role"), F.concat(F.lit("P "), text("l_partkey")).alias("to_tag"), F.lit(None).cast("string").alias("to_role"),
        F.col("flag").alias("medium"), F.col("flag").alias("signal"),
    )
    return assembly.resolve_connections(fragments, every.select(F.col("part").alias("key"), "part"), every)


CONNECTIONS = """
    with l as (select l_orderkey * 10 + l_linenumber line, l_orderkey o, l_linenumber n, l_suppkey s, l_partkey p, min(l_returnflag) flag from lineitem group by l_orderkey, l_linenumber, l_suppkey, l_partkey),
    j as (select l.*, s_nationkey % 3 ks, p_size % 3 kp, case when n % 2 = 1 then 'level' when n = 2 then 'drain' else '' end r from l left join supplier on s_suppkey = s and s_acctbal > -500 left join part on p_partkey = p),
    c as (select *, case when ks is null then 'not a known part' when ks = 2 and kp = 2 then 'both ends have connection-defined ports'
            when ks < 2 and kp = 1 then 'no port pair with matching domains'
            when ks = 0 and kp = 0 and r = 'level' then null when ks = 0 and kp = 0 then 'ambiguous ports'
            when ks = 1 and kp = 0 and r = 'drain' then null when ks = 1 and kp = 0 then 'ambiguous ports'
            when kp = 2 and ks = 1 then 'no signal port' when ks = 2 and kp = 1 then 'no signal port' end reason from j),
    f as (select *, case when ks = 2 then 'p' || p || '_command' else 's' || s || '_level' end st, case when ks = 2 then 's' || s else 'p' || p end ctl,
            case when ks = 2 and p % 2 = 0 then 'p' || p when ks < 2 and s % 2 = 0 then 's' || s end al from c where reason is null and (ks = 2 or kp = 2)),
    g as (select st, ctl, arg_min(coalesce(al, lower(flag)), line * 100000000 + s * 10000 + p) nm from f group by 1, 2),
    e as (select line, s, p, o, n, flag, case when ks = 0 then 's' || s || '_level' else 's' || s || '_drain' end a, case when ks = 0 then 'p' || p || '_command' else 'p' || p || '_inlet' end b from c where reason is null and ks < 2 and kp < 2
          union all select line, f.s, f.p, o, n, flag, case when ks = 2 then f.ctl || '_' || nm else f.st end, case when ks = 2 then f.st else f.ctl || '_' || nm end from f join g using (st, ctl))"""


@query(CONNECTIONS + """ select a as from_port, b as to_port, count(distinct line) as traces, arg_min(flag, line * 100000000 + s * 10000 + p) as medium from e group by 1, 2""")
def connections_resolved(t):
    return _connections(t)[0].select("from_port", "to_port", F.size("traces").alias("traces"), "medium")


@query(CONNECTIONS + " select line as chunk, s as supplier, p as part, reason from c where reason is not null")
def connection_problems(t):
    return _connections(t)[1].select("chunk", F.col("ord.s").alias("supplier"), F.col("ord.p").alias("part"), "reason")


@query("""with n as (select 'c' || c_custkey e, c_mktsegment kind, 'Valve ' || (c_custkey // 2) nm from customer), k as (select kind, nm, count(*) n, min(e) a, max(e) b from n group by 1, 2)
          select least(a, b) as entity, nm as name, cast(0.7 as double) as confidence from k where n = 2""")
def similar_merged(t):
    names = t.customer.select(F.concat(F.lit("c"), text("c_custkey")).alias("entity"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("Valve "), F.floor(F.col("c_custkey") / 2).cast("string")).alias("name"))
    merged, told = assembly.merge_similar(names)
    return told.join(merged.select("entity", "kept"), "entity").where("entity = kept").select("entity", F.col("name_a").alias("name"), "confidence")


@query("""with f as (select l_partkey e, l_orderkey * 10 + l_linenumber line, case when l_linenumber % 3 = 0 then 'PT-' || l_partkey % 500 else 'part ' || l_partkey || ' of ' || l_suppkey end tag,
                    case when l_linenumber % 2 = 0 then 'name ' || l_suppkey end nm, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end r, l_suppkey s from lineitem),
          b as (select e, arg_min(tag, (case when tag like 'PT-%' then 0 else 1 end) * 1e15 + r * 1e14 + line * 1e4 + s) tag, arg_min(nm, r * 1e14 + line * 1e4 + s) filter (where nm is not null) nm, count(distinct tag) tags, count(distinct line) traces from f group by 1),
          k as (select b.*, case p_type when 'STANDARD' then 'class' else lower(p_type) end kind, replace(replace(lower(tag), '-', '_'), ' ', '_') base from b join part on p_partkey = e where p_type <> 'PROMO')
          select e as entity, case when e = min(e) over (partition by base) then base else base || '_' || kind end as id, coalesce(nm, tag) as name, tags, traces from k""")
def parts_assembled(t):
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tag = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PT-"), (F.col("l_partkey") % 500).cast("string"))).otherwise(F.concat(F.lit("part "), text("l_partkey"), F.lit(" of "), text("l_suppkey")))
    fragments = t.lineitem.select(
        F.col("l_partkey").alias("entity"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("name "), text("l_suppkey"))).alias("name"), tag.alias("tag"), flag.alias("rank"), F.struct(line.alias("line"), F.col("l_suppkey").alias("s")).alias("ord"),
        F.lit("s").alias("source"), line.cast("string").alias("locator"),
    )
    kinds = t.part.select(F.col("p_partkey").alias("entity"), F.when(F.col("p_type") == "PROMO", "unknown").when(F.col("p_type") == "STANDARD", "class").otherwise(F.lower("p_type")).alias("kind"))
    return assembly.assemble_parts(fragments, kinds).select("entity", "id", "name", F.size("tags").alias("tags"), F.size("traces").alias("traces"))


@query("""select 'p' || p_partkey || '_' || r as id, 'p' || p_partkey as part, r as role from part join (values (0, 'in'), (0, 'out'), (1, 'in')) k(k, r) on k = p_size % 3""")
def ports_from_kinds(t):
    spec = t.spark.createDataFrame([("0", "in", "in", "fluid"), ("0", "out", "out", "fluid"), ("1", "in", "in", "fluid")], "kind string, role string, direction string, domain string")
    parts = t.part.select(F.concat(F.lit("p"), text("p_partkey")).alias("id"), (F.col("p_size") % 3).cast("string").alias("kind"))
    return assembly.part_ports(parts, spec).select("id", "part", "role")


@query("""select s_suppkey as id, s_nationkey as kind from (select *, count(*) over (partition by s_nationkey) n from supplier) where n > 1 and s_suppkey % 10 in (4, 7) and s_suppkey % 3 <> 0""")
def parts_that_name_the_system(t):
    tags = F.array(F.concat(F.lit("rm-"), (F.col("s_suppkey") % 10).cast("string")), F.when(F.col("s_suppkey") % 3 == 0, "fan").otherwise("room"))
    return assembly.system_names(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind"), tags.alias("tags")), "Room RM-4 beside RM-7")


@query("""with k as (select c_custkey s, case when c_custkey % 3 <> 0 then 'doc_' || c_nationkey || '_' || abs(cast(floor(c_acctbal / 500) as int)) end base from customer)
          select s as source_id, case when base is not null and s = min(s) over (partition by base) then base else 'src_' || s end as id from k""")
def source_names(t):
    document = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("DOC-"), text("c_nationkey"), F.lit("/"), F.abs(F.floor(F.col("c_acctbal") / 500)).cast("string")))
    return assembly.source_names(t.customer.select(F.col("c_custkey").alias("source_id"), document.alias("document")))


def _parameter_candidates(t):
    unit = F.get(F.array(*map(F.lit, ("kg", "min", "furlong", None))), (F.col("o_orderkey") % 4).cast("int"))
    fragments = t.orders.select(
        F.col("o_orderkey").alias("ord"), text("o_custkey").alias("owner"), F.when(F.col("o_orderkey") % 11 == 0, "--").otherwise("Set Value").alias("name"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("value"), unit.alias("unit"),
        F.when(F.col("o_orderkey") % 3 == 0, text("o_custkey")).alias("cited"), role("o_orderpriority").alias("role"), F.lit("2026").alias("date"), (F.col("o_orderstatus") == "P").alias("provisional"),
    )
    documents = t.customer.where("c_acctbal > 0").select(text("c_custkey").alias("key"), F.when(F.col("c_nationkey") % 2 == 0, "change_record").otherwise("datasheet").alias("role"), F.lit("2026-01-02").alias("date"), (F.col("c_nationkey") % 4 == 0).alias("approved"))
    return assembly.candidates(fragments, documents)


CANDIDATES = f"""
    with j as (select o_orderkey as ord, o_orderkey k, o_custkey, o_totalprice v, o_orderstatus st, {ROLE} "role", o_orderkey % 3 = 0 cites, c_nationkey n, c_custkey is not null and o_orderkey % 3 = 0 found
               from orders left join customer on c_custkey = o_custkey and c_acctbal > 0),
    r as (select *, case when k % 11 = 0 then 'the name has no letters or digits' when k % 13 = 0 then 'not a number' when k % 4 = 2 then 'unknown unit' end reason, case when found then case when n % 2 = 0 then 'change_record' else 'datasheet' end else "role" end ro,
                 case when found then n % 4 = 0 else true end ok from j)"""


@query(CANDIDATES + """ select ord, 'set_value' as name, case k % 4 when 1 then v * 60 else v end as si_value, case when ro = 'change_record' then case when ok then 1 else 6 end when ro = 'register' then 3 when ro = 'requirement_spec' then 3
          when ro = 'datasheet' then 4 else 6 end as "rank", case when found then '2026-01-02' end as date, st = 'P' or (ro = 'change_record' and not ok) as provisional from r where reason is null and k % 4 <> 3""")
def parameter_candidates(t):
    return _parameter_candidates(t)[0].where("si_unit is not null").select("ord", "name", "si_value", "rank", "date", "provisional")


@query(CANDIDATES + " select ord, reason from r where reason is not null union all select ord, 'the cited document is not known' from r where reason is null and cites and not found")
def parameter_problems(t):
    return _parameter_candidates(t)[1]


@query("""select cast(c_custkey as varchar) as name, 'cited, but not in the bundle' as why from customer where c_acctbal <= 0
          union all select distinct 'T' || l_suppkey, 'neither contained nor described' from lineitem where l_quantity > 49""")
def missing_documents(t):
    sources = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("path"))
    return assembly.missing_documents(sources, t.lineitem.where("l_quantity > 49").select(F.concat(F.lit("T"), text("l_suppkey")).alias("tag")))


@query("""with r as (select case when o_orderkey % 3 = 0 then 'ac_' || o_orderkey else 'test_' || o_custkey end id, o_orderkey k, o_orderstatus as text, cast(substr(o_orderpriority, 1, 1) as int) r from orders)
          select id, arg_min(text, r::bigint * 1000000000 + k) as text, count(*) as traces from r group by 1""")
def criteria_merged(t):
    tag = F.when(F.col("o_orderkey") % 3 == 0, "--").otherwise(F.concat(F.lit("Test-"), text("o_custkey")))
    rows = t.orders.select(tag.alias("tag"), F.col("o_orderkey").alias("chunk"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("text"))
    return assembly.merge_criteria(rows).select("id", "text", F.size("traces").alias("traces"))


@query("""select c_custkey as id, arg_min(o_totalprice, o_orderkey) as "check" from customer left join (select *, case when o_orderkey % 2 = 0 then o_custkey else o_custkey + 1 end who from orders) on who in (c_custkey, c_custkey + 5) group by 1""")
def criteria_checks(t):
    criteria = t.customer.select(F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("T-"), text("c_custkey")), F.concat(F.lit("t "), (F.col("c_custkey") + 5).cast("string"))).alias("tags"))
    checks = t.orders.select(F.concat(F.lit("T"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).cast("string")).alias("tag"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("check"))
    return assembly.criteria_checks(criteria, checks).select("id", "check")


@query("select o_orderkey as id from orders where o_orderstatus = 'F' and o_orderkey % 3 <> 0 and o_orderpriority <> '1-URGENT'")
def invariants(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "always").otherwise("at").alias("mode"), F.when(F.col("o_orderkey") % 3 == 0, 1.0).alias("start_s"), F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).alias("end_s"))
    return assembly.invariants(rows).select("id")


def _machine(t):
    """A machine a user: its transitions are the events; where the user's number is odd an order of commands is stated."""
    e = t.events.select(F.col("user_id").alias("machine"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.floor(F.col("value")).cast("int").alias("v"))
    from_state = F.when(F.col("v") % 11 == 0, "*").otherwise(F.concat(F.lit("s"), (F.col("v") % 7).cast("string")))
    to_state = F.when(F.col("v") % 13 == 0, "history").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    transitions = e.select("machine", "id", from_state.alias("from_state"), to_state.alias("to_state"), F.when(F.col("kind") != "error", F.col("kind")).alias("trigger"), (F.col("v") % 50).alias("priority"), F.array(F.lit("s1"), F.lit("s2")).alias("except_states"))
    states = e.select("machine").distinct().select("machine", F.explode(F.array(*(F.lit(f"s{i}") for i in range(6)))).alias("state"))
    events = e.where("kind <> 'signup'").select("machine", F.col("kind").alias("trigger")).distinct()
    precedence = events.where("machine % 2 = 1 and trigger in ('click', 'purchase')").withColumn("place", F.when(F.col("trigger") == "click", 1).otherwise(2))
    return assembly.assemble_transitions(transitions, states, events, precedence)


MACHINE = """
    with e as (select user_id m, event_id id, event_type kind, cast(floor(value) as int) v from events),
    t as (select m, id, case when v % 11 = 0 then '*' else 's' || v % 7 end f, case when v % 13 = 0 then 'history' else 's' || id % 7 end g, case when kind <> 'error' then kind end tr, v % 50 pr from e),
    x as (select * from t where f <> '*' union all select m, id, 's' || i, g, tr, pr from t, range(6) r(i) where f = '*' and i not in (1, 2) and g <> 's' || i),
    ev as (select distinct m, kind from e where kind <> 'signup'), pre as (select m, kind, case kind when 'click' then 1 else 2 end place from ev where m % 2 = 1 and kind in ('click', 'purchase')),
    rk as (select distinct m from pre),
    c as (select x.*, case when f = 's6' then 'from no kept state' when g = 's6' then 'to no kept state' when tr is not null and ev.m is null then 'no kept event' end reason from x left join ev on ev.m = x.m and ev.kind = x.tr),
    o as (select c.*, rk.m is not null ranked, case when rk.m is null then 0 when pre.place is not null then 0 when tr is not null then 1 else 2 end lv, coalesce(pre.place, pr) n from c left join pre on pre.m = c.m and pre.kind = c.tr left join rk on rk.m = c.m where reason is null),
    w as (select *, min(id) over (partition by m, f, lv, n) keep from o)"""


@query(MACHINE + """ select m as machine, id, f as from_state, g as to_state, tr as trigger, cast(case when ranked then row_number() over (partition by m, f order by lv, n) else pr end as int) as priority from w where id = keep""")
def machine_assembled(t):
    return _machine(t)[0]


@query(MACHINE + """ select m as machine, id, f as from_state, reason from c where reason is not null union all select m, id, f, 'the priority is taken' from w where id <> keep""")
def machine_dropped(t):
    return _machine(t)[1]


@query(MACHINE + " select m as machine, keep as kept, id as dropped, count(distinct f) as states from w where id <> keep group by 1, 2, 3")
def collision_questions(t):
    return assembly.collision_questions(_machine(t)[2]).select("machine", "kept", "dropped", F.size("states").alias("states"))


def _timed(t):
    e = t.events.select(F.col("user_id").alias("machine"), F.col("event_type").alias("state"), F.floor(F.col("value")).cast("int").alias("v"))
    states = e.select("machine", "state", F.array(F.concat(F.lit("start_timer(t"), (F.col("v") % 4).cast("string"), F.lit(")")), F.when(F.col("v") % 17 == 0, "save_history").otherwise("clear_history")).alias("actions"))
    transitions = e.select("machine", F.col("state").alias("from_state"), F.when(F.col("v") % 2 == 0, "history").otherwise(F.col("state")).alias("to_state"), F.array(F.concat(F.lit(" start_timer( t"), (F.col("v") % 9).cast("string"), F.lit(" )"))).alias("actions"))
    return states, transitions


TIMED = """with e as (select user_id m, event_type s, cast(floor(value) as int) v from events), o as (select distinct m, s, 't' || v % 4 t from e union select distinct m, s, 't' || v % 9 from e where v % 2 <> 0)"""


@query(TIMED + " select m as machine, s as state, t as timer from o")
def timer_owners(t):
    return assembly.timer_owners(*_timed(t))


@query(TIMED + " select distinct m as machine, t as timer from o where (m, s) in (select m, s from e where v % 17 = 0)")
def frozen_timers(t):
    states, transitions = _timed(t)
    return assembly.frozen_timers(assembly.timer_owners(states, transitions), states, transitions)
