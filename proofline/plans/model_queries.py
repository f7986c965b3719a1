"""Queries on values, graphs, gates, series, coverage and reports."""

from pyspark.sql import functions as F

from proofline.functions import units
from proofline.operators import acceptance, coverage, gates, graph, precedence, report, series
from proofline.plans.registry import query

KINDS = "['mm', 'cm', 'min', 'kPa', 'degC', 'furlong', 'kg/s per ACH', 'ppm']"


@query(f"""with u as (select unnest({KINDS}) unit, unnest(range(8)) i, unnest(['m', 'm', 's', 'Pa', 'K', null, 'kg', '1']) si_unit, unnest([1e-3, 1e-2, 60, 1e3, 1, null, 3600, 1e-6]) s, unnest([0, 0, 0, 0, 273.15, null, 0, 0]) o)
           select p_partkey, unit, si_unit, cast(p_retailprice as double) * cast(s as double) + cast(o as double) as si_value from part join u on u.i = p_size % 8""")
def units_to_si(t):
    return units.to_si(_measured(t), "value", "unit").select("p_partkey", "unit", "si_unit", "si_value")


def _measured(t):
    names = F.array(*(F.lit(u) for u in ("mm", "cm", "min", "kPa", "degC", "furlong", "kg/s per ACH", "ppm")))
    return t.part.select("p_partkey", F.col("p_retailprice").alias("value"), F.get(names, F.col("p_size") % 8).alias("unit"))


@query("select 'furlong' as unit, count(*) as parts from part where p_size % 8 = 5")
def units_unknown_questions(t):
    return units.to_si(_measured(t), "value", "unit").where("si_unit is null").groupBy("unit").agg(F.count("*").alias("parts"))


def _candidates(t):
    stated = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0), "effective").when(F.col("o_orderstatus") == "F", "superseded")
    return t.orders.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("date"), stated.alias("stated"), F.col("o_orderkey").alias("ord"))


PRECEDENCE = """
    with c as (select o_custkey key, o_totalprice as value, cast(substr(o_orderpriority, 1, 1) as int) "rank", case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end d,
               case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then 'effective' when o_orderstatus = 'F' then 'superseded' end stated, o_orderkey ord from orders),
    v0 as (select *, min("rank") over (partition by key, value) r from c),
    v as (select key, value, min(r) r, max(d) filter (where "rank" = r) d, min(ord) filter (where "rank" = r) o, bool_or(coalesce(stated = 'effective', false)) marked, bool_or(not coalesce(stated = 'superseded', false)) live from v0 group by key, value),
    k as (select *, count(*) over p n, sum(marked::int) over p nm, sum(live::int) over p nl, min(r) over p top from v window p as (partition by key)),
    x as (select *, (r = top) is_top, sum((r = top)::int) over p n_top, bool_and(r <> top or d is not null) over p dated, max(case when r = top then d end) over p latest, row_number() over (partition by key order by r, o) place from k window p as (partition by key)),
    y as (select *, sum((is_top and d = latest)::int) over (partition by key) n_latest from x),
    w as (select *, case when n = 1 then 'single' when nm = 1 or (nm = 0 and nl = 1) then 'status' when n_top = 1 then 'ladder' when dated and n_latest = 1 then 'later' else 'tie' end rule from y),
    z as (select *, case when n = 1 then true when nm = 1 then marked when rule = 'status' then live when rule = 'later' then is_top and d = latest else place = 1 end wins from w)
"""


@query(PRECEDENCE + "select key, value as winner, rule, n - 1 as losers from z where wins")
def precedence_winner(t):
    return precedence.choose(precedence.values(_candidates(t)))


@query(PRECEDENCE + """select key, value, r as "rank" from z where not wins""")
def precedence_superseded(t):
    found = precedence.values(_candidates(t))
    return precedence.superseded(found, precedence.choose(found))


@query(PRECEDENCE + "select key, n as n_candidates, top as best_rank, rule = 'tie' as open from z where wins and n > 1")
def precedence_conflicts(t):
    found = precedence.values(_candidates(t))
    return precedence.conflicts(found, precedence.choose(found)).select("key", "n_candidates", "best_rank", (F.col("resolution") == "unresolved").alias("open"))


@query(PRECEDENCE + "select key, n_top::bigint as options, value as default_if_unanswered from z where wins and rule = 'tie'")
def precedence_questions(t):
    found = precedence.values(_candidates(t))
    return precedence.questions(found, precedence.choose(found))


ROLES = "case l_linenumber " + " ".join(f"when {i + 1} then {r}" for i, r in enumerate((1, 2, 3, 4, 5, 6, 6))) + " end"


@query(f"""with e as (select l_partkey as input, l_suppkey as driver, min({ROLES}) r, -count(distinct l_orderkey) s from lineitem group by 1, 2), k as (select *, rank() over (partition by input order by r, s) place from e)
           select input, case when count(*) filter (where place = 1) = 1 then min(driver) filter (where place = 1) end as driver, count(*) as n_drivers from k group by input""")
def single_driver(t):
    roles = F.array(*(F.lit(r) for r in ("change_record", "review_decision", "register", "datasheet", "legacy_model", "correspondence", "other")))
    links = t.lineitem.select(F.col("l_partkey").alias("input"), F.col("l_suppkey").alias("driver"), precedence.rank_of(F.get(roles, F.col("l_linenumber") - 1)).alias("rank"), F.col("l_orderkey").alias("source"))
    return graph.single_drivers(links)


@query("""with e as (select l_suppkey entity, l_returnflag || l_linestatus kind, min(l_linenumber) r, count(*) n from lineitem group by 1, 2), k as (select *, rank() over (partition by entity order by r) place, row_number() over (partition by entity order by r, n desc, kind) i from e)
          select entity, min(kind) filter (where i = 1) as kind, count(*) filter (where place = 1) as tied from k group by entity""")
def kind_election(t):
    return graph.elect_kind(t.lineitem.select(F.col("l_suppkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_linenumber").alias("rank")))


@query("""select o_custkey as id, arg_min(o_orderpriority || o_orderkey, (o_orderpriority, o_orderkey)) as text, bool_or(o_orderstatus = 'P') as superseded,
          arg_min(case when o_orderkey % 3 = 0 then o_orderkey end, (o_orderpriority, o_orderkey)) filter (where o_orderkey % 3 = 0) as superseded_by, count(*) as statements from orders group by 1""")
def requirement_merge(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"), F.col("o_orderpriority").alias("rank"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "P").alias("superseded"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("superseded_by")
    )
    return precedence.merge_requirements(rows)


@query("select l_orderkey, min(l_suppkey) as owner from lineitem group by 1 having count(distinct l_suppkey) = 1")
def adopt_only_owner(t):
    return precedence.only_owner(t.lineitem, "l_orderkey", "l_suppkey")


@query("""with recursive d as (select l_partkey as key, l_extendedprice * (1 + l_linenumber * 4e-10) v, min(l_orderkey * 10 + l_linenumber) o, count(*) c from lineitem group by 1, 2), s as (select *, row_number() over (partition by key order by o, v) n from d),
          r as (select key, n, [v] heads, v head, c from s where n = 1 union all
                select key, n, case when len(hit) = 0 then list_append(heads, v) else heads end, case when len(hit) = 0 then v else hit[1] end, c
                from (select s.key, s.n, s.v, s.c, r.heads, list_filter(r.heads, lambda h: abs(h - s.v) <= greatest(1e-9 * greatest(abs(h), abs(s.v)), 1e-12)) hit from r join s on s.key = r.key and s.n = r.n + 1))
          select key, head, sum(c)::bigint as members from r group by 1, 2""")
def value_clusters_isclose(t):
    return precedence.clusters(t.lineitem.select(F.col("l_partkey").alias("key"), (F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 4e-10)).alias("value"), F.struct("l_orderkey", "l_linenumber").alias("ord")), "key", "value", "ord")


def _trade(t):
    return t.lineitem.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))


@query("""with recursive e as (select distinct l_suppkey * 2 a, l_partkey * 2 + 1 b from lineitem), u as materialized (select a, b from e union select b, a from e),
          r(node, root) using key (node) as (select a, least(a, min(b)) from u group by a
              union select u.b, min(r.root) from r join u on u.a = r.node join recurring.r old on old.node = u.b where r.root < old.root group by u.b)
          select node, root from r""")
def entity_components(t):
    return graph.components(_trade(t))


@query("""with f as (select l_partkey p, l_suppkey s, min(l_orderkey * 10 + l_linenumber) o from lineitem group by 1, 2)
          select 'name ' || p as node, arg_min('S-' || s, o) as root from f group by p union all select distinct 'S-' || s, 'S-' || s from f""")
def entity_components_veto(t):
    links = t.lineitem.select(F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("name "), F.col("l_partkey").cast("string")).alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    ranked = links.groupBy("a", "b").agg(F.min("ord").alias("ord"))
    return graph.components_with_veto(ranked, "^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")


def _parts(t):
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("r_name").alias("kind"))
    return c.union(t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "r_name"))


@query("""with n as (select n_nationkey k, r_name kind from nation join region on n_regionkey = r_regionkey), p as (select 'c' || c_custkey id, kind from customer join n on c_nationkey = k union all select 's' || s_suppkey, kind from supplier join n on s_nationkey = k),
          l as (select 's' || l_suppkey a, 'c' || o_custkey b from lineitem join orders on l_orderkey = o_orderkey)
          select what, count(*) as n from (select 'part ' || kind what from p union all select coalesce(x.kind, '?') || '->' || coalesce(y.kind, '?') from l left join p x on x.id = a left join p y on y.id = b) group by what""")
def topology_counts(t):
    links = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b"))
    return graph.topology(_parts(t), links)


@query("""select coalesce(a.k, b.k) as key, coalesce(n, 0) as n_first, coalesce(m, 0) as n_second from (select c_nationkey k, count(*) n from customer group by 1) a full join (select s_nationkey k, count(*) m from supplier group by 1) b on a.k = b.k where coalesce(n, 0) <> coalesce(m, 0)""")
def topology_repeatability(t):
    return graph.repeatability(t.customer.select(F.col("c_nationkey").alias("key")), t.supplier.select(F.col("s_nationkey").alias("key")), "key")


@query("""select *, 'removed' as change from (select c_nationkey as nation, c_acctbal > 0 as active from customer except all select s_nationkey, s_acctbal > 0 from supplier)
          union all select *, 'added' from (select s_nationkey, s_acctbal > 0 from supplier except all select c_nationkey, c_acctbal > 0 from customer)""")
def topology_multiset_diff(t):
    return graph.multiset_diff(t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("active")), t.supplier.select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("active")))


@query("select p_partkey as port from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
def unconnected_ports(t):
    return graph.unconnected(t.part.select(F.col("p_partkey").alias("port")), t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("port")))


@query("""select d as domain, n * m as pairs, case when n = 1 and m = 1 then s end as s_suppkey, case when n = 1 and m = 1 then c end as c_custkey
          from (select s_nationkey || ':' || cast(floor(s_acctbal / 500) as int) d, count(*) n, min(s_suppkey) s from supplier group by 1) join (select c_nationkey || ':' || cast(floor(c_acctbal / 500) as int) d, count(*) m, min(c_custkey) c from customer group by 1) using (d)""")
def port_pairing_unique(t):
    def domain(p):
        return F.concat_ws(":", F.col(f"{p}_nationkey").cast("string"), F.floor(F.col(f"{p}_acctbal") / 500).cast("string")).alias("domain")

    return graph.only_pair(t.supplier.select("s_suppkey", domain("s")), t.customer.select("c_custkey", domain("c")), "domain", ("s_suppkey", "c_custkey"))


@query("""select kind, signature, min(entity) as a, max(entity) as b from (select distinct p_type kind, substr(p_name, 1, 1) || p_size signature, p_partkey entity from part where regexp_matches(replace(p_name, ' ', ''), '^[a-z]+$')) group by 1, 2 having count(*) = 2""")
def similar_names(t):
    return graph.similar_names(t.part.select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("kind"), F.concat(F.regexp_replace("p_name", "[^a-z]", ""), F.col("p_size").cast("string")).alias("key")))


@query("select l_orderkey, count(distinct l_returnflag) as n, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as l_returnflag from lineitem group by 1")
def exactly_one(t):
    return graph.exactly_one(t.lineitem, "l_orderkey", "l_returnflag")


@query("""select id, count(*) as n from (select l_orderkey || '-' || l_linenumber id from lineitem union all select cast(o_orderkey as varchar) from orders) group by 1 having count(*) > 1""")
def integrity_unique_ids(t):
    return gates.repeated_ids([t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")), t.orders.select(F.col("o_orderkey").alias("id"))])


@query("select o_custkey, o_orderkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def integrity_foreign_keys(t):
    return gates.orphans(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


@query("select o_custkey, o_orderpriority, count(*) as n from orders where o_orderstatus = 'F' group by 1, 2 having count(*) > 1")
def integrity_effective_unique(t):
    return gates.repeated(t.orders, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""select l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, case when s.s_suppkey is null or p.p_partkey is null then 'unknown end' when s.s_nationkey % 3 <> p.p_size % 3 then 'domains differ' else 'wrong direction' end as reason
          from lineitem left join (select * from supplier where s_acctbal > 0) s on s_suppkey = l_suppkey left join part p on p_partkey = l_partkey where s.s_suppkey is null or p.p_partkey is null or s.s_nationkey % 3 <> p.p_size % 3 or p.p_type = 'ECONOMY'""")
def integrity_links(t):
    ports = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("port"), (F.col("s_nationkey") % 3).alias("domain"), F.lit("out").alias("direction")).union(
        t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size") % 3, F.when(F.col("p_type") == "ECONOMY", "out").otherwise("in"))
    )
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    return gates.bad_links(t.lineitem.select(key.alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")), ports)


@query("""select o_orderkey as id, case when c_custkey is null then 'unknown owner' else 'not an SI unit' end as reason from orders left join (select c_custkey from customer where c_acctbal > 0) on c_custkey = o_custkey where c_custkey is null or o_orderstatus = 'P'""")
def integrity_parameters(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "P", "furlong").otherwise("kg").alias("unit"))
    return gates.bad_parameters(rows, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), sorted({si for _, si, *_ in units.UNITS}))


@query("""select o_orderkey as id, case when o_orderstatus = 'F' and o_orderkey % 4 = 0 then 'no successor' when o_orderstatus <> 'F' then 'successor of an active one' else 'unknown successor' end as reason
          from (select *, case when o_orderkey % 4 <> 0 then o_orderkey + 1 end s from orders) where (o_orderstatus = 'F' and s is null) or (o_orderstatus <> 'F' and s is not null) or (s is not null and s not in (select o_orderkey from orders))""")
def integrity_requirements(t):
    return gates.bad_requirements(t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") + 1).alias("superseded_by")))


@query("""select p_partkey as id, case when p_size % 5 = 0 and p_size % 2 = 0 then 'neither check nor reason' when p_size % 5 = 1 and p_size % 3 = 0 then 'no start' else 'ends before it starts' end as reason from part
          where (p_size % 5 = 0 and p_size % 2 = 0) or (p_size % 5 = 1 and p_size % 3 = 0) or (p_size % 3 <> 0 and p_size > 30)""")
def integrity_criteria(t):
    s = F.col("p_size")
    return gates.bad_criteria(t.part.select(F.col("p_partkey").alias("id"), F.when(s % 2 != 0, "x").alias("reason"), F.when(s % 5 == 0, None).when(s % 5 == 1, "at").otherwise("always").alias("mode"), F.when(s % 3 != 0, s).alias("start_s"), F.lit(30).alias("end_s")))


def _levels(t):
    nations = t.nation.select(F.col("n_nationkey").alias("id"), F.lit(None).alias("parent"), (F.col("n_nationkey") % 4 != 0).alias("traced"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("parent"), (F.col("s_acctbal") > 1000).alias("traced"))
    lines = t.lineitem.select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))).alias("id"), F.col("l_suppkey").alias("parent"), (F.col("l_returnflag") != "R").alias("traced"))
    return [("part", nations), ("connection", suppliers), ("parameter", lines)]


GATE = """with n as (select *, n_nationkey % 4 = 0 gone from nation), s as (select s_suppkey, s_acctbal <= 1000 u, g.gone d from supplier left join n g on n_nationkey = s_nationkey),
          l as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey id, l_returnflag = 'R' u, coalesce(s.u or s.d, true) d from lineitem left join s on s_suppkey = l_suppkey),
          a as (select 'part' kind, cast(n_nationkey as varchar) id, gone u, false d from n union all select 'connection', cast(s_suppkey as varchar), u, d from s union all select 'parameter', id, u, d from l)"""


@query(GATE + "select kind, id from a where not u and not d")
def honesty_gate_kept(t):
    return gates.honesty(_levels(t))[0]


@query(GATE + "select kind, id, case when u then 'no trace and no assumption' else 'it depends on a removed element' end as reason from a where u or d")
def honesty_gate_rejected(t):
    return gates.honesty(_levels(t))[1]


@query("""select p_partkey as part, p_type as kind, n as name, d as "default", case when d is null then 'question' else 'assumption' end as outcome from part, (values ('A', 1.0), ('N', null), ('R', 2.5)) r(n, d)
          where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = n and l_quantity > 49)""")
def catalogue_defaults_missing(t):
    kinds = t.part.select(F.col("p_type").alias("kind")).distinct()
    defaults = F.array(F.struct(F.lit("A").alias("name"), F.lit(1.0).alias("default")), F.struct(F.lit("N").alias("name"), F.lit(None).cast("double").alias("default")), F.struct(F.lit("R").alias("name"), F.lit(2.5).alias("default")))
    required = kinds.select("kind", F.inline(defaults))
    return gates.missing_parameters(t.part.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind")), required, t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("name")))


@query("""select c_custkey as owner, 'acctbal' as name, c_acctbal as value from customer union all select c_custkey, 'limit', c_acctbal from customer where c_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') union all select c_custkey, 'limit', 100.0 from customer where c_mktsegment = 'BUILDING'""")
def conventions_applied(t):
    own = t.customer.select(F.col("c_custkey").alias("owner"), F.lit("acctbal").alias("name"), F.col("c_acctbal").alias("value"))
    stated = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("limit"), F.lit(100.0))
    return gates.conventions(own.union(stated), t.spark.createDataFrame([("acctbal", "limit")], "source string, target string"))


def _signal(t, error: bool):
    e = t.events.where(F.col("event_type") == "error" if error else F.col("event_type") != "error")
    return e.select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("ord"), "value")


WIDTH = 6 * 3600.0
SIGNALS = "with r as (select user_id series, epoch_us(ts) / 1e6 t, event_id ord, value from events where event_type <> 'error'), a as (select user_id series, epoch_us(ts) / 1e6 t from events where event_type = 'error'),"


@query(SIGNALS + """f as (select series, arg_min(value, (t, ord)) v from r group by 1) select a.series, a.t, coalesce(r.value, f.v) as value from a asof left join r on a.series = r.series and a.t >= r.t left join f on f.series = a.series""")
def asof_hold(t):
    return series.hold(_signal(t, False), _signal(t, True).select("series", "t"), WIDTH)


@query(SIGNALS + """x as (select a.*, p.t pt, p.value pv from a asof left join r p on a.series = p.series and a.t >= p.t), y as (select x.*, n.t nt, n.value nv from x asof left join r n on x.series = n.series and x.t <= n.t)
       select series, t, case when pt is null then nv when nt is null or pt = t then pv else pv + (nv - pv) * (t - pt) / (nt - pt) end as value from y""")
def asof_interpolate(t):
    return series.interpolate(_signal(t, False), _signal(t, True).select("series", "t"), WIDTH)


CHANGES = """c as (select series, t, ord, value, lag(value) over (partition by series order by t, ord) before from s), d as (select series, t, ord, value, row_number() over (partition by series order by t, ord) n from c where before is not null and value <> before)"""


def _levels_of(t, error):
    return _signal(t, error).withColumn("value", F.floor(F.col("value") / 20))


@query("with s as (select user_id series, epoch_us(ts) / 1e6 t, event_id ord, cast(floor(value / 20) as bigint) as value from events), " + CHANGES + " select * from d")
def state_changes(t):
    return series.changes(_levels_of(t, True).union(_levels_of(t, False)), "value", WIDTH)


PAIRS = " ".join(f"{p}s as (select user_id series, epoch_us(ts) / 1e6 t, event_id ord, cast(floor(value / 20) as bigint) as value from events where event_type {op} 'error'), " + CHANGES.replace("from s)", f"from {p}s)").replace("c as", f"{p}c as").replace("from c ", f"from {p}c ").replace("d as", f"{p}d as") + "," for p, op in (("x", "<>"), ("y", "=")))
PAIRED = "with " + PAIRS + "p as (select coalesce(xd.series, yd.series) series, coalesce(xd.n, yd.n) n, xd.t reference_time, xd.value reference_value, yd.t run_time, yd.value run_value, abs(yd.t - xd.t) time_error from xd full join yd on xd.series = yd.series and xd.n = yd.n), q as (select *, coalesce(reference_value = run_value and time_error <= 7200, false) ok from p) "


@query(PAIRED + "select * from q")
def pair_changes(t):
    return series.pair_changes(series.changes(_levels_of(t, False), "value", WIDTH), series.changes(_levels_of(t, True), "value", WIDTH), 7200.0)


@query(PAIRED + "select series, count(reference_time) as reference_changes, count(run_time) as run_changes, coalesce(max(time_error), 0) as max_time_error, case when bool_and(ok) then 'PASS' else 'FAIL' end as status from q group by series")
def discrete_verdicts(t):
    return series.discrete_verdict(pair_changes(t))


@query(SIGNALS.replace("a as (select user_id series, epoch_us(ts) / 1e6 t from", "a as (select user_id series, epoch_us(ts) / 1e6 t, value want from") + """f as (select series, arg_min(value, (t, ord)) v from r group by 1), s as (select a.series, a.t, a.want, coalesce(r.value, f.v) got from a asof left join r on a.series = r.series and a.t >= r.t left join f on f.series = a.series),
       g as (select series, max(abs(got - want)) m, arg_min(t, (-abs(got - want), t)) at_time, max(case when abs(want) > 1e-12 then abs(got - want) / abs(want) else 0 end) rel, count(*) n, coalesce(nullif(max(want) - min(want), 0), nullif(max(abs(want)), 0), 1.0) spread from s group by 1)
       select series, m as max_abs_error, at_time, rel as max_rel_error, n as samples, 0.9 * spread as "limit", case when m <= 0.9 * spread then 'PASS' else 'FAIL' end as status from g""")
def continuous_error(t):
    asked = _signal(t, True)
    got = series.hold(_signal(t, False), asked.select("series", "t"), WIDTH).withColumnRenamed("value", "got")
    return series.continuous_error(asked.select("series", "t", F.col("value").alias("want")).join(got, ["series", "t"]), 0.9)


RUN = "with r as (select user_id series, event_id ord, epoch_us(ts) / 1e6 t, value v, value > 10 and not (event_type = 'click') h from events), s as (select series, min(t) a, max(t) b from r group by 1), e as (select r.*, s.a, s.b, 1e-6 * greatest(1, abs(a)) x from r join s using (series)),"


@query(RUN + """g as (select series, arg_max(h, (t, ord)) filter (where t <= a + x) h0, count(*) filter (where t > a + x) n, min(t) filter (where t > a + x and not h) bad, min(t) filter (where t > a + x and h) good, min(a) a from e group by series)
       select 'always' as mode, series, case when h0 and bad is null then 'PASS' else 'FAIL' end as status, n + 1 as samples, case when not h0 then a else bad end as at from g
       union all select 'eventually', series, case when h0 or good is not null then 'PASS' else 'FAIL' end, n + 1, case when h0 then a else good end from g
       union all select 'at', series, case when h0 then 'PASS' else 'FAIL' end, n + 1, case when not h0 then a end from g""")
def criteria_always_eventually_at(t):
    run = t.events.select(F.col("user_id").alias("series"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", F.when(F.col("event_type") == "click", 1).otherwise(2).alias("state"))
    found = [acceptance.evaluate(run, m, "level > 10 and not in_state(clicked)", {"level": "value"}, states={"clicked": ("state", 1)}).withColumn("mode", F.lit(m)) for m in ("always", "eventually", "at")]
    return found[0].union(found[1]).union(found[2]).select("mode", "series", "status", "samples", "at")


MANY = RUN.replace("value > 10 and not (event_type = 'click') h", "event_type <> 'click' c") + """w as (select e.*, x.k, (v > x.k and c) or v < 1 h from e, (values (2), (10), (40), (90)) x(k)),
       g as (select series, k, arg_max(h, (t, ord)) filter (where t <= a + x) h0, count(*) filter (where t > a + x) n, min(t) filter (where t > a + x and not h) bad, min(t) filter (where t > a + x and h) good, min(a) a from w group by series, k)
"""


@query(MANY + """select 'always ' || k || ' ' || series as id, case when h0 and bad is null then 'PASS' else 'FAIL' end as status, n + 1 as samples, case when not h0 then a else bad end as at, cast(null as varchar) as reason from g
       union all select 'eventually ' || k || ' ' || series, case when h0 or good is not null then 'PASS' else 'FAIL' end, n + 1, case when h0 then a else good end, null from g
       union all select 'at ' || k || ' ' || series, case when h0 then 'PASS' else 'FAIL' end, n + 1, case when not h0 then a end, null from g
       union all select distinct 'unknown ' || series, 'NOT CHECKED', 0, null, 'other has no series' from g""")
def criteria_of_all_series(t):
    run = t.events.select(F.col("user_id").alias("series"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.create_map(F.lit("level"), "value", F.lit("state"), F.when(F.col("event_type") == "click", 1.0).otherwise(2.0)).alias("values"))
    levels = F.explode(F.array(*(F.lit(k) for k in (2, 10, 40, 90)))).alias("k")
    each = t.events.select(F.col("user_id").alias("series")).distinct().select("series", levels).select("*", F.explode(F.array(*(F.lit(m) for m in ("always", "eventually", "at")))).alias("mode"))
    condition = F.concat(F.lit("(level > "), F.col("k").cast("string"), F.lit(" and not in_state(clicked)) or level < 1"))
    none = F.lit(None).cast("double")
    criteria = each.select(F.concat_ws(" ", "mode", "k", "series").alias("id"), "series", "mode", condition.alias("condition"), none.alias("start"), none.alias("end"))
    unknown = each.select(F.concat_ws(" ", F.lit("unknown"), "series"), "series", F.lit("always"), F.lit("other > level"), none, none).distinct()
    return acceptance.evaluate_all(run, criteria.union(unknown), states={"clicked": ("state", 1)}).select("id", "status", "samples", "at", "reason")


@query("""with l as (select distinct doc_id id, unnest(string_split_regex(lower(source || ' ' || lang), '[^a-z0-9]+')) token from documents), r as (select distinct n_name as name, unnest(['src' || n_nationkey, case when n_regionkey = 0 then 'en' else 'fr' end]) token from nation),
          s as (select id, name, count(*) hits from l join r using (token) group by 1, 2), k as (select *, rank() over (partition by id order by hits desc) place from s)
          select id, max(hits) as hits, case when count(*) = 1 then min(name) end as name from k where place = 1 group by id""")
def map_column_best_match(t):
    left = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.split(F.lower(F.concat_ws(" ", "source", "lang")), "[^a-z0-9]+")).alias("token"))
    right = t.nation.select(F.col("n_name").alias("name"), F.explode(F.array(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")), F.when(F.col("n_regionkey") == 0, "en").otherwise("fr"))).alias("token"))
    return series.best_match(left, right)


@query("""with c as (select p_partkey k, list(distinct l_returnflag) v from part join lineitem on p_partkey = l_partkey group by 1) select k as "column", (case when len(list_filter(v, lambda x: x not in ('A', 'N', 'R'))) = 0 then 1 else 0 end + case when len(list_filter(v, lambda x: x not in ('A', 'R'))) = 0 then 1 else 0 end) as fits,
          case when len(list_filter(v, lambda x: x not in ('A', 'R'))) > 0 and len(list_filter(v, lambda x: x not in ('A', 'N', 'R'))) = 0 then 'full' end as machine from c""")
def map_columns_to_states(t):
    columns = t.lineitem.groupBy(F.col("l_partkey").alias("column")).agg(F.collect_set("l_returnflag").alias("values"))
    return series.map_states(columns, t.spark.createDataFrame([("full", ["A", "N", "R"]), ("short", ["A", "R"])], "machine string, aliases array<string>"))


@query("""with a as (select 'customer' c, 'n' || c_nationkey || ':' || cast(floor(c_acctbal / 100) as int) id from customer union select 'segment', c_mktsegment from customer), b as (select distinct 'customer' c, 'n' || s_nationkey || ':' || cast(floor(s_acctbal / 100) as int) id from supplier),
          j as (select coalesce(a.c, b.c) category, a.id x, b.id y from a full join b on a.c = b.c and a.id = b.id)
          select category, count(x) as reference, count(*) filter (where x is not null and y is not null) as matched, count(*) filter (where y is null) as missing, count(*) filter (where x is null) as extra,
          cast(case when count(x) = 0 then 100.0 else round(100.0 * cast(count(*) filter (where x is not null and y is not null) as double) / count(x), 2) end as double) as percent from j group by 1""")
def coverage_by_category(t):
    def key(p):
        return F.concat(F.lit("n"), F.col(f"{p}_nationkey").cast("string"), F.lit(":"), F.floor(F.col(f"{p}_acctbal") / 100).cast("string")).alias("id")

    reference = t.customer.select(F.lit("customer").alias("category"), key("c")).union(t.customer.select(F.lit("segment"), "c_mktsegment"))
    return coverage.by_id(reference, t.supplier.select(F.lit("customer").alias("category"), key("s")))


@query("""with a as (select printf('c%09d', c_custkey) id, c_nationkey || ':' || cast(floor(c_acctbal / 50) as int) k from customer), b as (select printf('s%09d', s_suppkey) id, s_nationkey || ':' || cast(floor(s_acctbal / 50) as int) k from supplier),
          x as (select *, row_number() over (partition by k order by id) n from a), y as (select *, row_number() over (partition by k order by id) n from b)
          select 'part' as category, x.id as reference, y.id as produced, 'alias' as "by" from x join y using (k, n)""")
def coverage_greedy_pairs(t):
    a = t.customer.select(F.lit("part").alias("category"), F.format_string("c%09d", "c_custkey").alias("id"), F.array(F.concat_ws(":", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 50).cast("string"))).alias("keys"))
    b = t.supplier.select(F.lit("part").alias("category"), F.format_string("s%09d", "s_suppkey").alias("id"), F.array(F.concat_ws(":", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 50).cast("string"))).alias("keys"))
    return coverage.greedy_pairs(a, b)


@query("""with a as (select c_nationkey owner, c_mktsegment as name, round(avg(c_acctbal), 2) w from customer group by 1, 2), b as (select s_nationkey owner, 'BUILDING' as name, min(s_acctbal) g from supplier group by 1)
          select coalesce(a.owner, b.owner) as owner, coalesce(a.name, b.name) as name, case when w is null then 'extra' when g is null then 'missing' when abs(w - g) <= greatest(1e-6 * greatest(abs(w), abs(g)), 1e-12) then 'matched' else 'mismatched' end as status from a full join b on a.owner = b.owner and a.name = b.name""")
def coverage_parameters(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).agg(F.round(F.avg("c_acctbal"), 2).alias("value"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("owner"), F.lit("BUILDING").alias("name")).agg(F.min("s_acctbal").alias("value"))
    return coverage.parameters(a, b).select("owner", "name", "status")


@query("""select o_orderkey as id, count(n) as satisfied_by, case when count(n) > 0 then 'satisfied' else 'not modelled' end as outcome from (select o_orderkey, (select min(p_partkey) from part where p_partkey = l_partkey and p_size > 40) n from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'F') group by 1""")
def requirements_split(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("satisfied_by"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("status"), "satisfied_by")
    return report.split_requirements(rows, t.part.where("p_size > 40").select(F.col("p_partkey").alias("id")))


@query("select l_partkey as kind, l_linestatus as name, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as type, count(*) as uses from lineitem group by 1, 2")
def typed_attribute_agreement(t):
    return report.agreed_types(t.lineitem.select(F.col("l_partkey").alias("kind"), F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("type")))


@query("select o_orderpriority as kind, count(*) as elements, count(*) filter (where o_orderkey % 3 > 0) as traced, count(*) filter (where o_orderkey % 3 = 0 and o_custkey % 2 = 1) as assumption_only, count(*) filter (where o_orderkey % 3 = 0 and o_custkey % 2 = 0) as inheriting from orders group by 1")
def traceability_totals(t):
    return report.traceability(t.orders.select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 3).alias("traces"), (F.col("o_custkey") % 2).alias("assumptions")))


@query("select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2")
def status_tally(t):
    return report.tally(t.orders, ["o_orderpriority"], "o_orderstatus")


@query("""select o_custkey, o_orderkey, o_totalprice, cast(place as int) as place, greatest(c - 5, 0) as more from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) place, count(*) over (partition by o_custkey) c from orders) where place <= 5""")
def summary_topk_more(t):
    return report.top_with_more(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


@query("select l_returnflag as model, count(*) as calls, sum(l_quantity) as input_tokens, sum(l_tax) as output_tokens, count(*) filter (where l_linestatus = 'F') as cached, round(sum(case when l_linestatus <> 'F' then (l_quantity * 2.5 + l_tax * 10.0) / 1e6 else 0 end), 6) as cost_usd from lineitem group by 1")
def usage_totals(t):
    return report.usage(t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_tax").alias("output_tokens"), (F.col("l_linestatus") == "F").alias("cached")), "model")


@query("""select user_id as run, case when bool_or(event_type in ('click', 'view') and c = 2) then 2 when bool_or(c = 3) then 3 when bool_or(c = 2) then 2 when bool_or(c = 1) then 1 else 0 end as exit_code from (select user_id, event_type, case when value > 70 then 2 when value > 60 then 3 when value > 50 then 1 else 0 end c from events) group by 1""")
def exit_code_fold(t):
    code = F.when(F.col("value") > 70, 2).when(F.col("value") > 60, 3).when(F.col("value") > 50, 1).otherwise(0)
    stage = F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "view", "extract").otherwise("verify")
    return report.exit_code(t.events.select(F.col("user_id").alias("run"), stage.alias("stage"), code.alias("code")))


@query("""select o_custkey as run, case when bool_or(o_orderstatus = 'F' and o_totalprice > 400000) then 'FAIL' when not bool_and(o_orderpriority <> '5-LOW' or o_totalprice > 5000) then 'NOT RUN' when bool_or(o_orderstatus = 'O') then 'PASS' else 'NOT CHECKED' end as verdict from orders group by 1""")
def overall_verdict(t):
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("NOT CHECKED")
    return acceptance.overall(t.orders.select(F.col("o_custkey").alias("run"), status.alias("status"), ((F.col("o_orderpriority") != "5-LOW") | (F.col("o_totalprice") > 5000)).alias("ok")), F.col("ok"))


@query("""select p_partkey as id, case when a and b then 'both' when a then 'first only' when b then 'second only' else 'missing' end as status from (select p_partkey, p_partkey in (select l_partkey from lineitem where l_quantity > 48) a, p_partkey in (select l_partkey from lineitem where l_quantity < 2) b from part)""")
def correspondence_status(t):
    return report.correspondence(t.part.select(F.col("p_partkey").alias("id")), t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("id")), t.lineitem.where("l_quantity < 2").select(F.col("l_partkey").alias("id")))


@query("""select o_custkey as key, o_orderstatus as value, min(r) as "rank", string_agg(s, ', ' order by r, s) as sources from (select distinct o_custkey, o_orderstatus, cast(substr(o_orderpriority, 1, 1) as int) r, strftime(o_orderdate, '%Y') s from orders) group by 1, 2""")
def conflict_lines(t):
    return report.conflict_lines(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), F.date_format("o_orderdate", "yyyy").alias("source"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank")))


@query("""select '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' as line from customer""")
def markdown_table(t):
    return report.markdown_rows(t.customer, ["c_custkey", "c_name", "c_mktsegment"])
