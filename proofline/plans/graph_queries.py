"""Queries on dependencies, layouts and order-dependent unions over the whole tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators import dependency, graph
from proofline.operators.dependency import Model
from proofline.operators.skew import dealt
from proofline.plans.registry import query


def key(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(".", *(F.col(c).cast("string") for c in columns)))


def _model(t) -> Model:
    """Nations as parts whose ports are customers and suppliers; orders and lines need several of what stands above them."""
    seats = t.customer.select(F.col("c_nationkey").alias("n"), key("c", "c_custkey").alias("q")).union(t.supplier.select("s_nationkey", key("s", "s_suppkey")))
    ports = seats.groupBy("n").agg(F.collect_list("q").alias("ports"))
    nations = t.nation.join(ports, F.col("n_nationkey") == F.col("n"), "left")
    none = F.expr("cast(array() as array<string>)")
    line = key("l", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    every = t.lineitem.select(*keys, (F.col("l_returnflag") != "R").alias("traced"), (F.col("l_quantity") < 50).alias("sound"))
    lines = dealt(every, keys, t.lineitem.count()).dropDuplicates(keys)
    return Model(
        parts=nations.select(key("n", "n_nationkey").alias("id"), (F.col("n_nationkey") % 5 != 0).alias("traced"), F.coalesce("ports", none).alias("ports")),
        connections=t.part.select(key("p", "p_partkey").alias("id"), (F.col("p_size") > 3).alias("traced"), key("s", "p_size").alias("from_port"), key("c", "p_partkey").alias("to_port")),
        parameters=t.orders.select(key("o", "o_orderkey").alias("id"), (F.col("o_orderpriority") != "5-LOW").alias("traced"), F.when(F.col("o_orderstatus") == "P", "system").otherwise(F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string"))).alias("owner")),
        machines=lines.select(
            line.alias("id"), "traced", F.lit("n1").alias("owner"), F.array(key("o", "l_orderkey"), key("s", "l_suppkey")).alias("operands"),
            none.alias("timers"), F.array(F.concat(F.lit("x"), line)).alias("states"), "sound",
        ),
        requirements=t.region.select(key("r", "r_regionkey").alias("id"), F.lit(True).alias("traced")),
        criteria=t.events.select(key("e", "event_id").alias("id"), (F.col("event_type") != "error").alias("traced"), F.when(F.col("value") > 1, F.array(key("c", "user_id"))).alias("operands"), F.lit(True).alias("sound")),
        conflicts=t.orders.where("o_totalprice > 300000").select(key("f", "o_orderkey").alias("id"), key("o", "o_orderkey").alias("subject")),
        candidates=t.lineitem.where("l_quantity > 30").select(key("f", "l_orderkey").alias("conflict"), key("s", "l_suppkey").alias("element"), F.col("l_linenumber").alias("place")),
        lists=t.lineitem.select(key("r", "l_linenumber").alias("record"), F.lit("affects").alias("what"), line.alias("element")),
    )


GONE = """
    with n as (select 'n' || n_nationkey id, n_nationkey k, n_nationkey % 5 = 0 gone from nation),
         q as (select 'c' || c_custkey id, coalesce(gone, true) gone from customer left join n on k = c_nationkey union all select 's' || s_suppkey, coalesce(gone, true) from supplier left join n on k = s_nationkey),
         p as (select 'p' || p_partkey id, case when p_size <= 3 then 'no trace and no assumption' when coalesce(a.gone, true) or coalesce(b.gone, true) then 'an end belonged to a removed part' end reason
               from part left join q a on a.id = 's' || p_size left join q b on b.id = 'c' || p_partkey),
         o as (select 'o' || o_orderkey id, case when o_orderpriority = '5-LOW' then 'no trace and no assumption' when o_orderstatus <> 'P' and coalesce(gone, true) then 'its owner ''n' || (o_custkey % 25) || ''' was removed' end reason
               from orders left join n on k = (o_custkey % 25)),
         li as (select distinct on (l_orderkey, l_linenumber, l_partkey, l_suppkey) * from lineitem),
         l as (select 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey id, case when l_returnflag = 'R' then 'no trace and no assumption'
                      when l_quantity >= 50 or o.id is null or o.reason is not null or coalesce(q.gone, true) then 'it refers to a removed element' end reason
               from li left join o on o.id = 'o' || l_orderkey left join q on q.id = 's' || l_suppkey),
         e as (select 'e' || event_id id, case when event_type = 'error' then 'no trace' end reason, value > 1 and coalesce(gone, true) cleared from events left join q on q.id = 'c' || user_id),
         f as (select 'f' || o_orderkey id, case when reason is not null then 'its subject ''o' || o_orderkey || ''' was removed' end reason from orders join o on o.id = 'o' || o_orderkey where o_totalprice > 300000)
"""


@query(GONE + """select 'part' as kind, id, 'no trace and no assumption' as reason from n where gone union all select 'connection', * from p where reason is not null union all select 'parameter', * from o where reason is not null
                 union all select 'state machine', * from l where reason is not null union all select 'acceptance criterion', id, reason from e where reason is not null union all select 'conflict', * from f where reason is not null""")
def honesty_graph_rejected(t):
    return dependency.gate(_model(t)).rejected


@query(GONE + """select kind, count(*) as n from (select 'part' kind from n where not gone union all select 'connection' from p where reason is null union all select 'parameter' from o where reason is null
                 union all select 'state machine' from l where reason is null union all select 'acceptance criterion' from e where reason is null union all select 'requirement' from region) group by 1""")
def honesty_graph_kept(t):
    return dependency.gate(_model(t)).kept.groupBy("kind").agg(F.count("*").alias("n"))


@query(GONE + "select id, case when cleared then 'its check referred to a removed element' end as reason from e where reason is null")
def honesty_graph_checks(t):
    return dependency.gate(_model(t)).checks


@query(GONE + """select 'candidate' as what, f.id, 's' || l_suppkey as element, not gone as known, count(*) as n from lineitem join f on f.id = 'f' || l_orderkey left join q on q.id = 's' || l_suppkey where f.reason is null and l_quantity > 30 and not gone group by all
                 union all select 'candidate', f.id, null, false, count(*) from lineitem join f on f.id = 'f' || l_orderkey left join q on q.id = 's' || l_suppkey where f.reason is null and l_quantity > 30 and coalesce(gone, true) group by all
                 union all select 'list', 'r' || l_linenumber, null, true, count(*) from lineitem join l on l.id = 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey where reason is null group by all""")
def honesty_graph_records(t):
    left = dependency.gate(_model(t))
    known = left.candidates.select(F.lit("candidate").alias("what"), F.col("conflict").alias("id"), "element", F.col("element").isNotNull().alias("known"))
    lists = left.lists.select(F.lit("list"), "record", F.lit(None).cast("string"), F.lit(True))
    return known.union(lists).groupBy("what", "id", "element", "known").agg(F.count("*").alias("n"))


def _flows(t) -> tuple[DataFrame, DataFrame]:
    """Customers feed their orders, orders their parts; open orders feed their customer back, which closes loops."""
    orders = t.orders.select(key("c", "o_custkey").alias("a"), key("o", "o_orderkey").alias("b"), F.col("o_orderstatus").alias("status"))
    back = orders.where("status = 'O'").select(F.col("b").alias("a"), F.col("a").alias("b"))
    parts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(key("o", "l_orderkey").alias("a"), key("p", "l_partkey").alias("b"))
    links = orders.select("a", "b").union(back).union(parts)
    return links, links.select(F.col("a").alias("node")).union(links.select("b")).distinct()


FLOWS = """with c as (select distinct 'c' || o_custkey a, 'o' || o_orderkey b from orders), p as (select distinct 'o' || l_orderkey a, 'p' || l_partkey b from lineitem where l_orderkey in (select o_orderkey from orders))"""


@query(FLOWS + " select a, b from c union all select a, b from p")
def layout_loops(t):
    return graph.without_loops(_flows(t)[0])


@query(FLOWS + """, r0 as (select node, row_number() over (order by node) - 1 as r from (select distinct a node from c)),
                 r1 as (select node, row_number() over (order by m, node) - 1 as r from (select b node, avg(r) m from c join r0 on node = a group by b)),
                 r2 as (select node, row_number() over (order by m, node) - 1 as r from (select b node, avg(r) m from p join r1 on node = a group by b)),
                 z as (select *, 0 k from r0 union all select *, 1 from r1 union all select *, 2 from r2)
          select node, k as "column", r as "row", k * 50 as x, cast(round_even(((count(*) over (partition by k) - 1) / 2.0 - r) * 40, 0) as bigint) as y from z""")
def layout_rows(t):
    return graph.layout(*_flows(t))
