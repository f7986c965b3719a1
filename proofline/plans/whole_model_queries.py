"""Queries on a whole model."""

from pyspark.sql import functions as F

from proofline.operators import model
from proofline.plans.registry import query


def _parameters(t):
    status = F.when(F.col("o_orderstatus") == "F", "effective").when(F.col("o_orderstatus") == "P", "verification_only").otherwise("superseded")
    return t.orders.groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("name"), status.alias("status")).agg(F.min("o_totalprice").alias("value"))


@query("""with p as (select o_custkey as owner, o_orderpriority as name, o_orderstatus s, min(o_totalprice) v from orders where o_orderstatus in ('F', 'P') group by 1, 2, 3)
          select owner, name, arg_min(v, s) as value, case min(s) when 'F' then 'effective' else 'verification_only' end as status from p group by 1, 2""")
def usable_parameters(t):
    return model.usable_parameters(_parameters(t))


@query("""select o_orderkey, case when o_orderpriority = '5-LOW' then 'as_built_only' when o_orderstatus = 'P' then 'verification_only' else 'nominal' end as variant from orders""")
def parameter_variants(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "As-Built state").alias("configuration"), F.when(F.col("o_orderstatus") == "P", "reference_data").otherwise("register").alias("role"))
    return model.variants(rows).select("o_orderkey", "variant")


@query("""with r as (select * from (values ('A', 1.0), ('N', null), ('R', 2.5)) r(n, d)), s as (select l_partkey p, l_returnflag n, max(l_quantity) v from lineitem where l_quantity > 49 group by 1, 2)
          select p_partkey as part, r.n as name, coalesce(v, d) as value, case when v is not null then 'stated' when d is not null then 'default' else 'missing' end as note from part cross join r left join s on s.p = p_partkey and s.n = r.n""")
def instance_bindings(t):
    kinds = t.part.select(F.col("p_type").alias("kind")).distinct()
    spec = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).cast("double").alias("default")) for n, d in (("A", 1.0), ("N", None), ("R", 2.5))))
    stated = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("owner"), F.col("l_returnflag").alias("name")).agg(F.max("l_quantity").alias("value"))
    return model.bindings(t.part.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind")), kinds.select("kind", F.inline(spec)), stated)


@query("select distinct n_regionkey as domain from nation union select s_nationkey % 7 from supplier")
def port_domains(t):
    return model.domains(t.nation.select(F.col("n_regionkey").alias("domain")), t.supplier.select((F.col("s_nationkey") % 7).alias("domain")))


@query("select n_name as id, 'world.' || n_name as path from nation union all select 's' || s_suppkey, 'world.' || n_name || '.s' || s_suppkey from supplier join nation on n_nationkey = s_nationkey")
def element_paths(t):
    ports = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("n_name").alias("part"))
    return model.paths(t.nation.select(F.col("n_name").alias("id")), ports, "world")


@query("""with s as (select distinct user_id machine, event_type state from events), r as (select distinct user_id machine, event_type state, case when event_type in ('click', 'view') then 'a' else 'b' end region from events where value > 2 union select distinct user_id, event_type, 'c' from events where value > 97),
          h as (select machine, state, count(distinct region) n, min(region) region from r group by 1, 2)
          select s.machine, s.state as item, case when n is null then 'in no region' else 'in several regions' end as reason from s left join h using (machine, state) where coalesce(n, 0) <> 1
          union all select e.user_id, cast(e.event_id as varchar), 'crosses regions' from events e join h a on a.machine = user_id and a.state = event_type join h b on b.machine = user_id and b.state = 'click' where a.region <> b.region""")
def region_faults(t):
    e = t.events.select(F.col("user_id").alias("machine"), F.col("event_type").alias("state"), "value", F.col("event_id").alias("id"))
    regions = e.where("value > 2").select("machine", F.when(F.col("state").isin("click", "view"), "a").otherwise("b").alias("region"), "state").union(e.where("value > 97").select("machine", F.lit("c"), "state")).distinct()
    return model.region_faults(e.select("machine", "state").distinct(), regions, e.select("machine", "id", F.col("state").alias("from_state"), F.lit("click").alias("to_state")))


@query("select l_partkey as name, l_orderkey as condition from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")
def unknown_operands(t):
    return model.unknown_operands(t.lineitem.select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("condition")), t.part.where("p_size > 25").select(F.col("p_partkey").alias("name"))).select("name", "condition")


@query("""select s_suppkey as id, 'unknown kind' as reason from supplier where s_nationkey >= 20 union all
          select s_suppkey, case when s_suppkey % 3 = 2 then 'unknown role' when s_suppkey % 3 = 0 and s_acctbal > 5000 then 'wrong direction' else 'wrong domain' end from supplier where s_nationkey < 20 and (s_suppkey % 3 = 2 or (s_suppkey % 3 = 0 and s_acctbal > 5000) or s_nationkey % 2 = 1)""")
def model_against_catalogue(t):
    s = t.supplier
    spec = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("kind"), F.explode(F.array(F.struct(F.lit("r0").alias("role"), F.lit("in").alias("direction"), F.lit("fluid").alias("domain")), F.struct(F.lit("r1").alias("role"), F.lit("out").alias("direction"), F.lit("fluid").alias("domain")))).alias("x")).select("kind", "x.*")
    ports = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("part"), F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("role"), F.when((F.col("s_suppkey") % 3 == 1) | (F.col("s_acctbal") > 5000), "out").otherwise("in").alias("direction"), F.when(F.col("s_nationkey") % 2 == 1, "thermal").otherwise("fluid").alias("domain"))
    return model.against_catalogue(s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind")), ports, spec)


@query("""with f as (select c_custkey s, 'f' || c_nationkey || '.pdf' b from customer), n as (select b, count(*) n, min(s) s from f group by 1), g as (select s_nationkey || '-x' w, count(*) n, min(s_suppkey) s from supplier group by 1)
          select p_partkey as id, coalesce(case when n.n = 1 then n.s end, (select case when count(*) = 1 then min(c_custkey) end from customer where c_custkey = p_size * 3)) as source_id from part left join n on n.b = 'f' || p_size || '.pdf'""")
def bundle_match(t):
    files = t.customer.select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string"), F.lit(".pdf")).alias("basename"), F.concat(F.lit("Report TAG-"), F.col("c_custkey").cast("string")).alias("title"))
    docs = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".PDF")).alias("file_name"), F.concat(F.lit("tag-"), (F.col("p_size") * 3).cast("string")).alias("tag"))
    return model.bundle_match(docs, files)


@query("select 'stop' as setting, min(c_acctbal) as value from customer where c_mktsegment like '%ING' having count(distinct c_acctbal) = 1 union all select 'size', min(9) from customer where c_mktsegment like '%HOLD'")
def run_values(t):
    c = t.customer.select(F.col("c_mktsegment").alias("name"), F.when(F.col("c_mktsegment").endswith("HOLD"), 9.0).otherwise(F.col("c_acctbal")).alias("value"))
    return model.run_values(c, {"ING": "stop", "HOLD": "size"})


@query("select user_id as series, min(value) as start, max(value) as stop, case when count(*) > 1 then (max(value) - min(value)) / (count(*) - 1) end as step from events group by 1")
def run_span(t):
    return model.run_span(t.events.select(F.col("user_id").alias("series"), F.col("value").alias("t")))


@query("select l_orderkey as part, 'flag' as name, min(l_returnflag) as value from lineitem group by 1 having count(distinct l_returnflag) = 1")
def only_value_adopted(t):
    required = t.spark.createDataFrame([("order", "flag"), ("other", "a"), ("other", "b")], "kind string, name string")
    return model.only_value(required, t.lineitem.select(F.col("l_orderkey").alias("part"), F.lit("order").alias("kind"), F.col("l_returnflag").alias("value")))


@query("select o_orderkey as id, coalesce('doc-' || c_custkey, cast(o_custkey as varchar)) as source_id from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def renamed_sources(t):
    names = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("old"), F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("new"))
    return model.renamed(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source_id")), names)


@query("""select distinct l_suppkey as user, l_partkey as port from lineitem join part on p_partkey = l_partkey where l_suppkey <> p_size and l_partkey not in (select l_partkey from lineitem where l_quantity > 49) and l_linenumber = p_size % 7""")
def foreign_port_links(t):
    uses = t.lineitem.select(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("port"), F.concat(F.lit("state of Part_"), F.col("l_linenumber").cast("string"), F.lit(".")).alias("text"))
    ports = t.part.select(F.col("p_partkey").alias("port"), F.col("p_size").alias("part"), F.concat(F.lit("part_"), (F.col("p_size") % 7).cast("string")).alias("name"))
    return model.foreign_links(uses, ports, t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("port")))


@query("select l_orderkey as from_port, min(l_suppkey) as to_port from lineitem group by 1 having count(distinct l_suppkey) = 1")
def feeds_one_input(t):
    return model.feeds_one(t.lineitem.select(F.col("l_orderkey").alias("from_port"), F.col("l_suppkey").alias("to_port")))


@query("select p_partkey as id, (select count(distinct l_orderkey) from lineitem where l_partkey = p_partkey and l_quantity > 45) as assumptions from part")
def assumptions_of_elements(t):
    a = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("assumption")).agg(F.collect_list("l_partkey").alias("affects"))
    return model.assumptions_of(t.part.select(F.col("p_partkey").alias("id")), a)


@query("select r_name as gate, r_name || ': ' || case when r_regionkey = 0 then 'NOT RUN: no tool' when r_regionkey = 1 then 'NOT RUN: no result' else 'PASS' end as line from region")
def gate_lines(t):
    return model.gate_lines(t.region.select(F.col("r_name").alias("gate"), F.when(F.col("r_regionkey") > 1, "PASS").alias("status"), F.when(F.col("r_regionkey") == 0, "no tool").alias("reason")))


@query("with f as (select user_id machine, props guard, min(event_id) a from events group by 1, 2) select machine, cast(row_number() over (partition by machine order by a) as int) as n, guard from f")
def when_conditions(t):
    return model.conditions(t.events.select(F.col("user_id").alias("machine"), F.col("event_id").alias("ord"), F.col("props").alias("guard")))


@query("select coalesce(arg_min(c_acctbal, c_custkey) filter (where c_mktsegment = 'MACHINERY'), 2.0) as value, count(*) filter (where c_mktsegment = 'MACHINERY') > 0 as stated from customer")
def event_tolerance(t):
    p = t.customer.select(F.col("c_custkey").alias("id"), F.lit("system").alias("owner"), F.when(F.col("c_mktsegment") == "MACHINERY", "event_tolerance").otherwise("x").alias("name"), F.lit("s").alias("unit"), F.lit("effective").alias("status"), F.col("c_acctbal").alias("value"))
    return model.tolerance(p, 2.0)


@query("select c_custkey, case when c_mktsegment = 'BUILDING' and c_acctbal > 0 then 1 else 2 end as wave from customer")
def read_waves(t):
    rows = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", "register").otherwise("datasheet").alias("role"))
    return model.wave(rows, F.col("c_acctbal") <= 0).select("c_custkey", "wave")
