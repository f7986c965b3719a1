"""Queries that hold a result against a reference model, and reports on where elements come from, over whole tables."""

from pyspark.sql import functions as F

from proofline.operators import acceptance, graph, honesty, matching
from proofline.operators.skew import dealt
from proofline.plans.registry import query


def text(column):
    return F.col(column).cast("string")


def _ids(t):
    """Lines as ports of their part: the result has those under 40 pieces, every other one under another id.

    Both sides are cut from one pass over the lines, so that these are grouped once. The last item is about how many ports there are.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = t.lineitem.count()
    key = F.concat_ws("-", *(text(k) for k in keys))
    lines = dealt(t.lineitem.select(*keys, "l_quantity", "l_returnflag"), keys, n).groupBy(*keys).agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("role"))
    made = F.explode(F.array_compact(F.array(F.lit(False), F.when(F.col("q") < 40, True)))).alias("made")
    ports = lines.select(*keys, "role", made)
    name = F.when(~F.col("made") | (F.col("l_linenumber") % 2 == 0), key).otherwise(F.concat(F.lit("x"), key))
    sides = (ports.where(side).select(name.alias("id"), F.col("l_partkey").alias("part"), "role") for side in ("not made", "made"))
    part_map = t.part.where("p_size > 10").select(F.col("p_partkey").alias("reference"), F.col("p_partkey").alias("produced"))
    return part_map, *sides, 2 * n


PORTS = """
    with l as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey id, l_partkey part, l_linenumber n, min(l_quantity) q, min(l_returnflag) r from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey),
    a as (select * from l where part in (select p_partkey from part where p_size > 10)), b as (select case when n % 2 = 0 then id else 'x' || id end id, part, r from l where q < 40),
    s as (select a.id from a join b on a.id = b.id and a.part = b.part), x as (select *, row_number() over (partition by part, r order by id) k from a where id not in (select id from s)),
    y as (select *, row_number() over (partition by part, r order by id) k from b where id not in (select id from s)),
    m as (select id as reference, id as produced, 'id' as "by" from s union all select x.id, y.id, 'alias' from x join y using (part, r, k))"""


@query(PORTS + " select * from m")
def covered_ports(t):
    return matching.covered_ports(*_ids(t))


@query("""with a as (select o_orderkey id, o_custkey a, o_custkey % 25 b from orders), p as (select case when o_orderkey % 3 = 0 then o_orderkey else -o_orderkey end id, o_custkey a, o_custkey % 25 b from orders where o_orderstatus <> 'O'),
          s as (select id from a join p using (id)), m as (select c_custkey c from customer where c_acctbal > 0), x as (select *, row_number() over (partition by a, b order by id) k from a where id not in (select id from s) and a in (select c from m) and b in (select c from m)),
          y as (select *, row_number() over (partition by a, b order by id) k from p where id not in (select id from s))
          select id as reference, id as produced, 'id' as "by" from s union all select x.id, y.id, 'alias' from x join y using (a, b, k)""")
def covered_links(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") % 25).alias("b"), "o_orderstatus")
    b = a.where("o_orderstatus <> 'O'").withColumn("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-F.col("id")))
    same = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("reference"), F.col("c_custkey").alias("produced"))
    return matching.covered_links(same, a.drop("o_orderstatus"), b.drop("o_orderstatus"))


def _machines(t):
    reference = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    produced = t.orders.where("o_orderstatus = 'F'").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("id"), F.col("o_custkey").alias("owner"))
    return t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("reference"), F.col("c_custkey").alias("produced")), reference, produced


@query("""with p as (select case when o_orderkey % 2 = 0 then o_orderkey else -o_orderkey end id, o_custkey c from orders where o_orderstatus = 'F'), l as (select c, max(id) id from p where c in (select c_custkey from customer where c_acctbal > 0) group by 1)
          select o_orderkey as reference, coalesce(p.id, l.id) as produced from orders left join p on p.id = o_orderkey left join l on l.c = o_custkey where coalesce(p.id, l.id) is not null""")
def matched_machines(t):
    return matching.matched_machines(*_machines(t))


def _states(t):
    """States of a nation's machine: the customers' segments; the result has them under ids in capitals for even nations."""
    both = t.customer.select(F.col("c_nationkey").alias("machine"), F.col("c_mktsegment").alias("id")).distinct()
    reference = both.select("machine", "id", F.array(F.lower("id")).alias("keys"))
    produced = both.where("id <> 'FURNITURE'").select("machine", F.when(F.col("machine") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id")).alias("id"), F.array(F.lower("id"), F.lit("z")).alias("keys"))
    return t.nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("reference"), F.col("n_nationkey").alias("produced")), reference, produced


@query("""select distinct c_nationkey as machine, c_mktsegment as reference, case when c_nationkey % 2 = 0 then c_mktsegment else 'x' || c_mktsegment end as produced, case when c_nationkey % 2 = 0 then 'id' else 'alias' end as "by"
          from customer where c_mktsegment <> 'FURNITURE' and c_nationkey <> 3""")
def covered_states(t):
    return matching.covered_states(*_states(t)).withColumn("machine", F.col("machine").cast("int"))


@query("""with a as (select user_id m, event_id id, event_type a, case when event_id % 4 = 0 then 'history' when event_id % 4 = 1 then 'click' else 'view' end b from events),
          p as (select m, case when id % 5 = 0 then id else -id end id, a, b from a where id % 3 <> 0), s as (select m, id from a join p using (m, id)),
          x as (select *, row_number() over (partition by m, a, b order by id) k from a where (m, id) not in (select m, id from s) and a <> 'error'), y as (select *, row_number() over (partition by m, a, b order by id) k from p where (m, id) not in (select m, id from s))
          select m as machine, id as reference, id as produced, 'id' as "by" from s union all select m, x.id, y.id, 'alias' from x join y using (m, a, b, k)""")
def covered_transitions(t):
    b = F.when(F.col("event_id") % 4 == 0, "history").when(F.col("event_id") % 4 == 1, "click").otherwise("view")
    a = t.events.select(F.col("user_id").alias("machine"), F.col("event_id").alias("id"), F.col("event_type").alias("a"), b.alias("b"))
    produced = a.where("id % 3 <> 0").withColumn("id", F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(-F.col("id")))
    users = t.events.select(F.col("user_id").alias("machine")).distinct()
    machines = users.select(F.col("machine").alias("reference"), F.col("machine").alias("produced"))
    kinds = users.select("machine", F.explode(F.array(*map(F.lit, ("click", "view", "purchase", "signup", "login", "logout", "scroll")))).alias("reference")).withColumn("produced", F.col("reference"))
    return matching.covered_transitions(machines, kinds, a, produced)


def _columns(t):
    """Columns by customer, whose nation is the part; the ports of a part are its suppliers."""
    rest = F.array(F.concat(F.lit("b"), F.abs(F.floor(F.col("c_acctbal") / 500)).cast("string")), F.lower("c_mktsegment"))
    columns = t.customer.select(F.col("c_custkey").alias("column"), F.col("c_nationkey").alias("part"), rest.alias("rest"), F.when(F.col("c_custkey") % 3 == 0, "K").when(F.col("c_custkey") % 3 == 1, "m").alias("si_unit"))
    tokens = F.array(F.concat(F.lit("b"), F.abs(F.floor(F.col("s_acctbal") / 500)).cast("string")), F.when(F.col("s_suppkey") % 4 == 0, "building").otherwise("x"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "signal_real").when(F.col("s_suppkey") % 3 == 0, "signal_bool").otherwise("fluid")
    ports = t.supplier.select(
        F.col("s_suppkey").alias("port"), F.col("s_nationkey").alias("part"), tokens.alias("tokens"), F.when(F.col("s_suppkey") % 5 < 3, "out").otherwise("in").alias("direction"), kind.alias("domain"),
        F.when(F.col("s_suppkey") % 7 != 0, "K").alias("si_unit"), F.when(F.col("s_suppkey") % 8 != 0, "s_name").alias("variable"),
    )
    return columns, ports


@query("""with c as (select c_custkey c, c_nationkey n, 'b' || abs(cast(floor(c_acctbal / 500) as int)) x, lower(c_mktsegment) y, case c_custkey % 3 when 0 then 'K' when 1 then 'm' end u from customer),
          p as (select s_suppkey s, s_nationkey n, 'b' || abs(cast(floor(s_acctbal / 500) as int)) x, case when s_suppkey % 4 = 0 then 'building' else 'x' end y, s_suppkey % 5 < 3 o, case when s_suppkey % 2 = 0 then 'signal_real' when s_suppkey % 3 = 0 then 'signal_bool' else 'fluid' end d,
                       case when s_suppkey % 7 <> 0 then 'K' end u, s_suppkey % 8 <> 0 has from supplier),
          h as (select c, s, (c.x = p.x)::int + (c.y = p.y)::int h from c join p using (n) where c.x = p.x or c.y = p.y), b as (select c, h, count(*) k, min(s) s from h group by 1, 2), w as (select c, max(h) h from b group by 1), best as (select b.* from b join w using (c, h)),
          o as (select n, count(*) k, min(s) s from p where o and d <> 'fluid' group by 1),
          j as (select c.c, c.u cu, best.k bk, case when best.k = 1 then best.s when best.k is null and o.k = 1 then o.s end port from c left join best using (c) left join o using (n)),
          r as (select c, port, d, case when bk > 1 then 'ports fit equally' when port is null then 'no port fits' when cu <> u then 'units differ' when not has then 'no variable' end reason from j left join p on s = port)
          select c as "column", case when reason is null then port end as port, case when reason is null then case when d = 'signal_bool' then 'discrete' else 'continuous' end end as kind, reason from r""")
def columns_to_ports(t):
    return matching.choose_ports(*_columns(t)).drop("variable")


@query("""select s_suppkey as "column", case when s_suppkey % 7 = 0 then 'NOT COMPARED' when s_suppkey % 5 = 0 and s_acctbal > 0 then 'FAIL' when s_acctbal <= 0 then 'NOT COMPARED' when s_suppkey % 3 = 0 and s_nationkey > 12 then 'NOT COMPARED'
                 when s_suppkey % 2 = 0 then 'PASS' else 'FAIL' end as status,
                 case when s_suppkey % 7 = 0 then 'ambiguous' when s_suppkey % 5 = 0 and s_acctbal > 0 then 'the run ends before the reference' when s_acctbal <= 0 then 'not in the result' when s_suppkey % 3 = 0 and s_nationkey > 12 then 'no state enumeration' end as why from supplier""")
def signal_results(t):
    s = t.supplier
    mappings = s.select(F.col("s_suppkey").alias("column"), F.col("s_name").alias("variable"), F.when(F.col("s_suppkey") % 3 == 0, "state").otherwise("continuous").alias("kind"), F.col("s_nationkey").alias("machine"), F.when(F.col("s_suppkey") % 7 == 0, "ambiguous").alias("reason"))
    verdicts = s.select(F.col("s_suppkey").alias("column"), F.when(F.col("s_suppkey") % 2 == 0, "PASS").otherwise("FAIL").alias("status"))
    known = t.nation.where("n_nationkey <= 12").select(F.col("n_nationkey").alias("machine"))
    return matching.compare_signals(mappings, s.where("s_acctbal > 0").select(F.col("s_name").alias("variable")), verdicts, known, F.col("column") % 5 == 0)


@query("""select p_partkey as machine, case when p_size % 4 = 0 then null when p_size % 4 = 2 then null else p_brand end as variable, case p_size % 4 when 0 then 'no state enumeration' when 2 then 'does not follow the states' end as reason from part""")
def state_enumerations(t):
    machines = t.part.select(F.col("p_partkey").alias("machine"), F.array(F.lit("idle"), "p_type").alias("states"))
    literals = F.array(F.when(F.col("p_size") % 4 == 1, "idle_").otherwise("idle"), F.when(F.col("p_size") % 4 == 2, "other").otherwise(F.col("p_type")))
    return matching.enumerations(machines, t.part.where("p_size % 4 <> 0").select(F.col("p_partkey").alias("machine"), F.col("p_brand").alias("variable"), literals.alias("literals")))


@query("""select s_suppkey as port, case when n_nationkey is not null and r_regionkey < 3 then n_name || '.' || r_name end as series, case when n_nationkey is null then 'no instance in the model' when r_regionkey is null or r_regionkey >= 3 then 'no connector for the role' end as note
          from supplier left join nation on n_nationkey = s_nationkey and n_nationkey <> 4 left join region on r_regionkey = s_suppkey % 6""")
def series_names(t):
    ports = t.supplier.select(F.col("s_suppkey").alias("port"), F.col("s_nationkey").alias("part"), F.lit("k").alias("kind"), (F.col("s_suppkey") % 6).alias("role"))
    connectors = t.region.where("r_regionkey < 3").select(F.lit("k").alias("kind"), F.col("r_regionkey").cast("long").alias("role"), F.col("r_name").alias("connector"))
    return matching.series_names(ports, t.nation.where("n_nationkey <> 4").select(F.col("n_nationkey").alias("part"), F.col("n_name").alias("instance")), connectors)


@query("""with e as (select o_orderkey id, case o_orderkey % 5 when 0 then 'parameter' when 1 then 'requirement' when 2 then 'acceptance criterion' when 3 then 'region' else 'part' end tp,
                            case o_orderpriority when '1-URGENT' then 'superseded' when '2-HIGH' then 'verification_only' else 'effective' end st, o_orderstatus = 'F' a, o_custkey % 2 = 0 b from orders),
          x as (select *, case when (tp = 'parameter' and st <> 'effective') or (tp = 'requirement' and st = 'superseded') or tp = 'acceptance criterion' then 'n/a' when a then 'found' else 'MISSING' end f,
                       case when (tp = 'parameter' and st = 'superseded') or tp in ('requirement', 'region') or (tp = 'acceptance criterion' and not b) then 'n/a' when b then 'found' else 'MISSING' end s from e)
          select id, f as in_first, s as in_second, case when f = 'MISSING' and s = 'MISSING' then 'MISSING (first, second)' when f = 'MISSING' then 'MISSING (first)' when s = 'MISSING' then 'MISSING (second)' else 'OK' end as layers from x""")
def element_layers(t):
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 0, "parameter").when(k == 1, "requirement").when(k == 2, "acceptance criterion").when(k == 3, "region").otherwise("part")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "superseded").when(F.col("o_orderpriority") == "2-HIGH", "verification_only").otherwise("effective")
    elements = t.orders.select(F.col("o_orderkey").alias("id"), kind.alias("type"), status.alias("status"))
    first = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return matching.layers(elements, first, t.orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"))).drop("type")


@query("""select c_custkey as source_id, coalesce(case when c_custkey % 3 <> 0 then 'DOC-' || c_nationkey end, cast(c_custkey as varchar)) || case when c_custkey % 2 = 0 then ' Rev ' || c_mktsegment else '' end as label from customer""")
def source_labels(t):
    tags = F.when(F.col("c_custkey") % 3 != 0, F.array(F.concat(F.lit("DOC-"), text("c_nationkey")), F.lit("other"))).otherwise(F.expr("cast(array() as array<string>)"))
    return honesty.source_labels(t.customer.select(F.col("c_custkey").alias("source_id"), tags.alias("tags"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("revision")))


@query("""with l as (select o_orderkey id, o_custkey c, o_orderpriority p, o_orderstatus st, count(l_orderkey) n, min(l_linenumber * 100000 + l_suppkey) f from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 40 group by all),
          a as (select l_partkey k, string_agg(distinct 'as' || l_suppkey, ', ' order by 'as' || l_suppkey) t from lineitem where l_quantity > 48 group by 1)
          select case when id % 2 = 0 then 'Ports' else 'Parts' end as "group", case when id % 2 = 0 then 2 else 1 end as place, id,
                 case when n > 0 then f % 100000 || ' (S' || f % 100000 || ')' when id % 2 = 0 and st <> 'O' then 'inherits ' || c else 'assumption only' end as source,
                 case when n > 0 then 'line ' || f // 100000 || case when n > 1 then ' (+' || n - 1 || ' more)' else '' end else '' end as locator, coalesce(t, '') || case when st = 'O' then case when t is null then 'own' else ', own' end else '' end as assumed from l left join a on k = id""")
def trace_rows(t):
    # The sources of an order are its lines over 40 pieces; assumptions (suppliers) touch the orders whose number is one of their parts'.
    lines = t.lineitem.where("l_quantity > 40").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.struct(x["l_suppkey"].alias("source_id"), F.concat(F.lit("line "), x["l_linenumber"].cast("string")).alias("locator"), F.lit("q").alias("quote"))).alias("traces"))
    o = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    port = F.col("o_orderkey") % 2 == 0
    elements = o.select(F.when(port, "Ports").otherwise("Parts").alias("group"), text("o_orderkey").alias("id"), "traces", F.when(F.col("o_orderstatus") == "O", F.array(F.lit("own"))).alias("own"), F.when(port, text("o_custkey")).alias("inherits"))
    assumptions = t.lineitem.where("l_quantity > 48").groupBy(F.concat(F.lit("as"), text("l_suppkey")).alias("assumption")).agg(F.collect_set(text("l_partkey")).alias("affects"))
    found = honesty.trace_rows(elements, assumptions, t.supplier.select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("S"), text("s_suppkey")).alias("label")))
    return found.select("group", "place", F.col("id").cast("long").alias("id"), "source", "locator", "assumed")


@query("""with e as (select o_orderkey id, case when o_orderkey % 2 = 0 then o_orderkey + 1 end par, case when o_orderkey % 3 = 0 then o_custkey end s, case when o_orderkey % 5 = 0 then o_custkey % 40 end a from orders)
          select id, 'unknown source' as reason from e where s is not null and s not in (select c_custkey from customer where c_acctbal > 0) union all select id, 'unknown assumption' from e where a is not null and a >= 25
          union all select e.id, 'no trace and no assumption' from e left join e p on p.id = e.par where e.s is null and e.a is null and (p.id is null or (p.s is null and p.a is null))""")
def unsupported_elements(t):
    k = F.col("o_orderkey")
    none = F.expr("cast(array() as array<bigint>)")
    elements = t.orders.select(k.alias("id"), F.when(k % 2 == 0, k + 1).alias("parent"), F.when(k % 3 == 0, F.array("o_custkey")).otherwise(none).alias("sources"), F.when(k % 5 == 0, F.array(F.col("o_custkey") % 40)).otherwise(none).alias("assumptions"))
    return honesty.unsupported(elements, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("source_id")), t.nation.select(F.col("n_nationkey").cast("long").alias("assumption")))


@query("select distinct l_orderkey as id, l_partkey as element from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def record_faults(t):
    records = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("affects"))
    return honesty.bad_records(records, t.part.where("p_size > 5").select(F.col("p_partkey").alias("id")))


@query("""with c as (select o_orderkey id, o_custkey s from orders), d as (select l_orderkey id, l_suppkey s, case when l_linenumber % 2 = 0 then l_partkey end e from lineitem)
          select id, 'unknown subject' as reason from c where s not in (select c_custkey from customer where c_acctbal > 0) union all select distinct id, 'unknown source' from d where s not in (select s_suppkey from supplier where s_acctbal > 0)
          union all select distinct id, 'unknown element' from d where e is not null and e not in (select c_custkey from customer where c_acctbal > 0)
          union all select id, 'fewer than two candidates' from c where (select count(*) from d where d.id = c.id) < 2""")
def conflict_faults(t):
    candidates = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("element"))
    elements = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return honesty.bad_conflicts(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject")), candidates, elements, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id")))


@query("""with s as (select c_custkey // 2 id, case when c_acctbal > 0 then 'read' else 'partial' end st, case when c_nationkey > 5 then 'why' end r from customer)
          select cast(id as varchar) as id, 'repeated source' as reason from s group by 1 having count(*) > 1 union all select cast(id as varchar), 'no reason' from s where st <> 'read' and r is null
          union all select cast(o_orderkey as varchar), 'unknown source' from orders where o_custkey not in (select id from s)""")
def evidence_faults(t):
    half = F.floor(F.col("c_custkey") / 2)
    sources = t.customer.select(half.alias("source_id"), F.when(F.col("c_acctbal") > 0, "read").otherwise("partial").alias("status"), F.when(F.col("c_nationkey") > 5, "why").alias("reason"))
    return honesty.bad_evidence(sources, t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("source_id")))


def _machine(t):
    e = t.events.select(F.col("user_id").alias("machine"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.floor(F.col("value")).cast("int").alias("v"))
    machines = e.select("machine").distinct().select("machine", F.col("machine").alias("owner"), F.when(F.col("machine") % 3 == 0, "off").otherwise("click").alias("initial"))
    states = e.where("kind <> 'error'").groupBy("machine", F.col("kind").alias("state")).agg(F.collect_set(F.col("v") % 20).alias("outputs"), F.array(F.when(F.max("v") > 250, "save_history").otherwise("none")).alias("actions"))
    events = e.where("v % 9 = 0").select("machine", F.concat(F.lit("e"), text("id")).alias("event"), (F.col("v") % 20).alias("port"))
    trigger = F.when(F.col("v") % 4 == 0, F.concat(F.lit("e"), text("id")))
    transitions = e.select("machine", "id", F.col("kind").alias("from_state"), F.when(F.col("v") % 31 == 0, "history").otherwise(F.lit("view")).alias("to_state"), trigger.alias("trigger"), (F.col("id") % 50).alias("priority"), F.expr("cast(array() as array<string>)").alias("actions"))
    owners = e.select("machine").distinct().where("machine % 5 <> 0")
    ports = owners.select(F.col("machine").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("port")).withColumn("direction", F.when(F.col("port") % 2 == 0, "in").otherwise("out"))
    return honesty.bad_machines(machines, states, events, transitions, ports)


@query("""with e as (select user_id m, event_id id, event_type k, cast(floor(value) as int) v from events), ma as (select distinct m from e), st as (select m, k, max(v) > 250 sv from e where k <> 'error' group by 1, 2), ow as (select m from ma where m % 5 <> 0),
          ev as (select m, 'e' || id ev, v % 20 p from e where v % 9 = 0)
          select m as machine, cast(m as varchar) as item, 'the owner has no ports' as reason from ma where m % 5 = 0
          union all select m, case when m % 3 = 0 then 'off' else 'click' end, 'the initial state is none of its states' from ma where m % 3 = 0 or (m, 'click') not in (select m, k from st)
          union all select m, ev, 'the event''s port is no input of the owner' from ev where not (m % 5 <> 0 and p <= 15 and p % 2 = 0)
          union all select * from (select distinct m, cast(v % 20 as varchar) p, 'not an output of the owner' from e where k <> 'error' and not (m % 5 <> 0 and v % 20 <= 15 and v % 2 = 1))
          union all select m, cast(id as varchar), 'from no state' from e where (m, k) not in (select m, k from st)
          union all select m, cast(id as varchar), 'to no state' from e where v % 31 <> 0 and (m, 'view') not in (select m, k from st)
          union all select m, cast(id as varchar), 'no such event' from e where v % 4 = 0 and v % 9 <> 0
          union all select m, k, 'a priority is used twice' from e group by m, k, id % 50 having count(*) > 1
          union all select * from (select distinct m, cast(m as varchar), 'returns to history that nothing saves' from e where v % 31 = 0 and m not in (select m from st where sv))""")
def machine_faults(t):
    return _machine(t)


@query("""with p as (select p_partkey k, p_size s, p_brand r from part)
          select k as kind, 'r' as item, 'connector of no port' as reason from p where s % 4 = 0 and s % 3 <> 0 union all select k, 'q', 'port without a connector' from p where s % 5 <> 0 and s % 3 = 0 union all select k, 'r', 'port without a connector' from p where s % 5 <> 0 and s % 3 = 0 and s % 4 <> 0
          union all select k, 'n', 'no parameter mapping' from p where s % 7 = 0 union all select k, 'n', 'no assumption text' from p where s % 2 = 0 and s % 8 = 0 union all select k, 'n', 'not an SI unit' from p where s % 2 = 0 and s % 6 = 0
          union all select k, 'q', 'not an SI unit' from p where s % 3 = 0 and s % 9 = 0 union all select k, 'q', 'measures by no input' from p where not (s % 3 = 0) union all select k, 'w', 'no kind''s output' from p where s % 10 = 0""")
def catalogue_faults(t):
    p = t.part.select(F.col("p_partkey").alias("kind"), F.col("p_size").alias("s"))
    ports = p.where("s % 3 = 0").select("kind", F.explode(F.array(F.struct(F.lit("q").alias("role"), F.lit("in").alias("direction"), F.when(F.col("s") % 9 == 0, "psi").alias("unit")), F.struct(F.lit("r").alias("role"), F.lit("out").alias("direction"), F.lit(None).cast("string").alias("unit")))).alias("x")).select("kind", "x.*")
    mapped = p.where("s % 4 = 0").select("kind", F.lit("r").alias("role"))
    even = F.col("s") % 2 == 0
    parameters = p.select("kind", F.lit("n").alias("name"), (F.col("s") % 7 != 0).alias("mapped"), F.lit(False).alias("needed"), F.when(even, F.when(F.col("s") % 6 == 0, "psi").otherwise("m")).alias("unit"), F.when(even, F.when(F.col("s") % 8 == 0, " ").otherwise("so")).alias("assumption"))
    measures = p.select("kind", F.lit("q").alias("role"), F.when(F.col("s") % 10 == 0, "w").otherwise("r").alias("measured"))
    return honesty.bad_catalogue(p.select("kind", (F.col("s") % 5 == 0).alias("dynamic")), ports, mapped, parameters, measures, ["m", "s"])


@query("""select distinct l_orderkey as machine, l_partkey as name, case when p_size > 25 then 'port' when p_size > 10 then 'parameter' else 'unknown' end as what, exists (select 1 from lineitem x where x.l_orderkey = l.l_orderkey and x.l_partkey = l.l_partkey and x.l_quantity > 45) as clash
          from lineitem l join part on p_partkey = l_partkey""")
def guard_operands(t):
    uses = t.lineitem.select(F.col("l_orderkey").alias("machine"), F.col("l_partkey").alias("name"))
    name = F.col("p_partkey").alias("name")
    return honesty.operands(uses, t.part.where("p_size > 25").select(name), t.part.where("p_size > 10").select(name), t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("machine"), F.col("l_partkey").alias("name")))


@query("""with u as (select distinct l_orderkey id, l_suppkey % 5 n from lineitem), c as (select distinct s_nationkey c, s_suppkey % 5 n from supplier), h as (select id, c, count(*) h from u join c using (n) group by 1, 2), d as (select id, count(*) d from u group by 1)
          select o_orderkey as id, min(c) as controller from orders left join (select id, c from h join d using (id) where h = d) on id = o_orderkey group by 1""")
def asserted_criteria(t):
    uses = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("name"))
    return honesty.asserted(t.orders.select(F.col("o_orderkey").alias("id")), uses, t.supplier.select(F.col("s_nationkey").alias("controller"), (F.col("s_suppkey") % 5).alias("name")))


@query("select name, count(*) as n from (select p_name as name from part union all select p_brand from part where p_size > 20) group by 1 having count(*) > 1")
def repeated_names(t):
    return honesty.repeated_names(t.part.select(F.col("p_name").alias("name")).union(t.part.where("p_size > 20").select("p_brand")))


@query("""with w as (select c_nationkey as system, min(c_acctbal) filter (where c_mktsegment = 'BUILDING') start_time, min(c_acctbal) filter (where c_mktsegment = 'MACHINERY') stop_time, min(c_acctbal) filter (where c_mktsegment = 'FURNITURE') iv from customer group by 1)
          select system, start_time, coalesce(stop_time, 1.0) as stop_time, coalesce(iv, (coalesce(stop_time, 1.0) - coalesce(start_time, 0.0)) / 500) as output_interval, (stop_time is null)::int + (iv is null)::int as defaults from w""")
def experiments(t):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "start_time").when(F.col("c_mktsegment") == "MACHINERY", "stop_time").when(F.col("c_mktsegment") == "FURNITURE", "output_interval").otherwise("x")
    return honesty.experiments(t.customer.select(F.col("c_nationkey").alias("system"), name.alias("name"), F.col("c_acctbal").alias("value")))


@query("""with k as (select c_nationkey m, c_mktsegment k, count(*) n from customer group by 1, 2), c as (select s_nationkey m, count(*) c from supplier group by 1), g as (select m, sum(n)::bigint n, string_agg(n || ' ' || k, ', ' order by k) ks from k group by 1)
          select m as model, 'The model holds ' || n || case when n = 1 then ' part (' else ' parts (' end || ks || ') joined by ' || coalesce(c, 0) || case when c = 1 then ' connection.' else ' connections.' end as text from g left join c using (m)""")
def descriptions(t):
    return honesty.descriptions(t.customer.select(F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("kind")), t.supplier.select(F.col("s_nationkey").alias("model")))


@query("""select l_orderkey as id, l_linenumber as "rank", l_returnflag as value, l_suppkey as source_id, case when l_returnflag = case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'unresolved' end then 'winner' else 'lost' end as outcome from lineitem join orders on o_orderkey = l_orderkey""")
def conflict_outcomes(t):
    conflicts = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("unresolved").alias("resolution"))
    return honesty.conflict_outcomes(conflicts, t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("value"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("rank")))


@query("""select 'q' || o_orderkey as id, '- q' || o_orderkey || ': Which? Options: ' || case when o_orderkey % 2 = 0 then 'a / b' else 'none listed' end || '; default if unanswered: ' || case when o_orderkey % 3 = 0 then 'a' else 'none stated' end || '; '
          || case when o_orderkey % 5 = 0 then 'answer: ' || o_orderstatus else 'unanswered' end || '. Affects: ' || case when o_orderkey % 7 = 0 then cast(o_custkey as varchar) else '—' end || '.' as line from orders""")
def question_lines(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.concat(F.lit("q"), text("o_orderkey")).alias("id"), F.lit("Which?").alias("text"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("options"), F.when(k % 3 == 0, "a").alias("default"), F.when(k % 5 == 0, F.col("o_orderstatus")).alias("answer"),
        F.when(k % 7 == 0, F.array(text("o_custkey"))).otherwise(F.expr("cast(array() as array<string>)")).alias("affects"),
    )
    return honesty.question_lines(rows)


@query("select 'f' || c_custkey as path, '- partial: `f' || c_custkey || '` — ' || case when c_nationkey > 5 then c_mktsegment else 'no reason given' end as line from customer where c_acctbal <= 0")
def unread_lines(t):
    rows = t.customer.select(F.concat(F.lit("f"), text("c_custkey")).alias("path"), F.when(F.col("c_acctbal") > 0, "read").otherwise("partial").alias("status"), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).otherwise("").alias("reason"))
    return honesty.unread_lines(rows)


@query("select p_partkey as key, p_size as n, p_name || ' = 1' as note from part where p_size % 3 = 0")
def declared_defaults(t):
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  x = 1; // ASSUMPTION (generator default):  "), "p_name", F.lit(" = 1"))).otherwise(F.concat(F.lit("// ASSUMPTION: "), "p_name"))
    return honesty.declared_defaults(t.part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("n"), line.alias("line")))


@query("""select 1 as section, 'p' || p_partkey as id, '  p' || p_partkey || ' (' || p_type || ') -> ' || case when p_size > 10 then p_brand else 'generated controller' end as line from part
          union all select 2, 'o' || o_orderkey, '  o' || o_orderkey || ': c' || o_custkey || ' -> ' || o_orderstatus from orders""")
def summary_lines(t):
    parts = t.part.select(F.concat(F.lit("p"), text("p_partkey")).alias("id"), F.col("p_type").alias("kind"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("class"))
    return honesty.summary_lines(parts, t.orders.select(F.concat(F.lit("o"), text("o_orderkey")).alias("id"), F.concat(F.lit("c"), text("o_custkey")).alias("from_port"), F.col("o_orderstatus").alias("to_port")))


@query("""select o_orderkey as id, case when o_orderkey = 77 then 'FAIL' when o_orderkey % 3 = 0 or o_orderkey % 7 = 0 then 'NOT CHECKED' when o_orderstatus = 'F' then 'PASS' else 'FAIL' end as status,
                 case when o_orderkey = 77 then '77: level too high' when o_orderkey % 3 = 0 then coalesce(case when o_orderkey % 2 = 0 then o_orderpriority end, 'no machine-checkable form') when o_orderkey % 7 = 0 then 'not evaluated: there is no simulation result' else o_orderstatus end as reason from orders""")
def criteria_results(t):
    k = F.col("o_orderkey")
    criteria = t.orders.select(k.alias("id"), (k % 3 != 0).alias("checkable"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("reason"))
    evaluated = t.orders.where("o_orderkey % 7 <> 0").select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"), F.col("o_orderstatus").alias("reason"))
    return acceptance.results(criteria, evaluated, "77: level too high")


@query("""with p as (select s_nationkey part, s_suppkey port, case when s_suppkey % 3 = 0 then 'left' else 'right' end side from supplier)
          select part, port, side, round_even(100 - 200 * (row_number() over (partition by part, side order by port) - 0.5) / count(*) over (partition by part, side), 0)::double as y from p""")
def icon_positions(t):
    ports = t.supplier.select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("port"), F.when(F.col("s_suppkey") % 3 == 0, "in").otherwise("out").alias("direction"), F.col("s_suppkey").alias("ord"))
    return graph.icon_positions(ports).select("part", "port", "side", "y")
