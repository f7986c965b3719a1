"""Queries on sources, sinks, windows, roles and the condition language over the whole tables."""

from pyspark.sql import functions as F

from proofline.functions import expressions
from proofline.operators import assembly, evidence, render, schedule, series
from proofline.operators.skew import spread
from proofline.plans.registry import query
from proofline.sources import tables
from proofline.storage import new_path

SECONDS = "epoch_us(ts) / 1e6"


@query("""with f as (select url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') b from pages)
          select url as path, case when n = 1 then b else b || '_' || n end as source_id from (select *, row_number() over (partition by b order by url) n from f)""")
def source_ids_of_paths(t):
    return evidence.source_ids(t.pages.select(F.col("url").alias("path")))


@query("select 'value' as column, cast(event_id as double) as t, cast(value as varchar) as cell from events union all select 'event_type', event_id, event_type from events")
def reference_cells(t):
    path = new_path(t.spark, "reference")
    t.events.select("value", F.col("event_id").alias(" Time_s"), "event_type").write.option("header", True).csv(path)
    return tables.unpivoted(t.spark, path).drop("ord")


@query("""select case when count(*) = 1 then min('run/' || p_partkey || '.csv') end as path, case when count(*) = 0 then 'no reference data' when count(*) > 1 then 'several reference files' end as reason
          from part where p_size > 2 and p_retailprice = (select max(p_retailprice) from part where p_size > 2)""")
def reference_found(t):
    most = t.part.where("p_size > 2").agg(F.max("p_retailprice").alias("most"))
    sources = t.part.join(F.broadcast(most)).select(
        F.concat(F.lit("run/"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"), F.when(F.col("p_size") > 2, "csv").otherwise("json").alias("format"), F.when(F.col("p_retailprice") == F.col("most"), "reference_data").otherwise("other").alias("role")
    )
    return tables.find_reference(sources)


@query("select cast(s_nationkey as varchar) as model, s_name as schema, cast(s_acctbal as varchar) as response from supplier")
def replies_read(t):
    path = new_path(t.spark, "replies")
    spread(t.supplier, "s_suppkey").select(F.col("s_nationkey").cast("string").alias("model"), F.col("s_name").alias("schema"), F.col("s_acctbal").cast("string").alias("response")).write.option("maxRecordsPerFile", 1).json(path)
    return tables.replies(t.spark, path).drop("key")


@query("select c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def reply_misses(t):
    return tables.misses(t.customer.select(F.col("c_custkey").alias("key")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


@query("select c_custkey, c_name, round(c_acctbal, 2) as c_acctbal from customer")
def json_sink(t):
    """Written twice: what was there before goes."""
    path = new_path(t.spark, "sink")
    tables.write_json(t.nation.select(F.col("n_nationkey").alias("c_custkey")), path, ["c_custkey"])
    tables.write_json(t.customer.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path, ["c_custkey"])
    return t.spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


@query("select n_name || ': ' || count(c_custkey) as line from nation left join customer on c_nationkey = n_nationkey group by n_name")
def report_sink(t):
    path = new_path(t.spark, "report")
    counts = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))
    tables.write_lines(counts.select("n_name", F.concat_ws(": ", "n_name", F.col("n").cast("string")).alias("line")), path, ["n_name"])
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("select 'orders' as name, cast(o_orderkey as varchar) as id, o_orderstatus as kind from orders union all select 'parts', cast(p_partkey as varchar), p_type from part")
def model_sink(t):
    path = new_path(t.spark, "model")
    orders = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("kind"))
    tables.write_model({"orders": orders, "parts": t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("kind"))}, path)
    return t.spark.read.parquet(f"{path}/orders").select(F.lit("orders").alias("name"), "id", "kind").union(t.spark.read.parquet(f"{path}/parts").select(F.lit("parts"), "id", "kind"))


def _signal(t, error: bool):
    e = t.events.where(F.col("event_type") == "error" if error else F.col("event_type") != "error")
    return e.select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query(f"""with a as (select user_id series, min({SECONDS}) s, max({SECONDS}) e from events where event_type = 'error' group by 1), b as (select user_id series, min({SECONDS}) s, max({SECONDS}) e from events where event_type <> 'error' group by 1)
           select series, greatest(a.s, b.s) as start, least(a.e, b.e) as "end" from a join b using (series)""")
def common_spans(t):
    return series.span(_signal(t, True), _signal(t, False))


@query(f"""with w as (select user_id series, min({SECONDS}) s, case when user_id % 3 > 0 then max({SECONDS}) end e from events where event_type = 'error' group by user_id)
           select series, count(*) as inside, min({SECONDS}) as first, max({SECONDS}) as last from events join w on series = user_id
           where {SECONDS} > s + 1e-6 * greatest(1, abs(s)) and (e is null or {SECONDS} < e - 1e-6 * greatest(1, abs(e))) group by series""")
def window_rows(t):
    windows = _signal(t, True).groupBy("series").agg(F.min("t").alias("s"), F.max("t").alias("e")).withColumn("e", F.when(F.col("series") % 3 > 0, F.col("e")))
    rows = t.events.select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).join(windows, "series")
    return rows.where(series.in_window(F.col("t"), F.col("s"), F.col("e"))).groupBy("series").agg(F.count("*").alias("inside"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("""with s as (select source, min(lang) r, case when count(*) % 2 = 0 then 'read' else 'unread' end status from documents group by source)
          select doc_id, source as source_id, coalesce(case when lang <> 'en' then lang end, r) as role from documents join s using (source) where status <> 'unread'""")
def chunk_roles(t):
    chunks = t.documents.select("doc_id", F.col("source").alias("source_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("role"))
    sources = t.documents.groupBy(F.col("source").alias("source_id")).agg(F.min("lang").alias("role"), F.when(F.count("*") % 2 == 0, "read").otherwise("unread").alias("status"))
    return evidence.with_roles(chunks, sources).select("doc_id", "source_id", "role")


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 'sheet ' || l_returnflag || ', part, ' || l_linestatus end as tab from lineitem")
def tables_of_locators(t):
    rows = F.concat(F.lit("sheet "), "l_returnflag", F.lit(", part, "), "l_linestatus", F.when(F.col("l_linenumber") % 2 == 0, F.lit(", row ")).otherwise(", line "), F.col("l_orderkey").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", schedule.table_of(rows).alias("tab"))


def _conditions(t):
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit("((a"), n, F.lit(" > "), q, F.lit(")) and (not (timer_expired(t"), n, F.lit(")) or in_state(on"), n, F.lit(")) or b"), n, F.lit(" <= a"), n)
    names = F.create_map(F.concat(F.lit("a"), n), F.concat(F.lit("port_"), q))
    broken = F.when(F.col("l_returnflag") == "R", F.concat(text, F.lit(" and"))).otherwise(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", broken.alias("condition"), names.alias("names"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_returnflag <> 'R' then 'port_' || q || ' > ' || q || ' and (not timer_expired(t' || n || ') or in_state(on' || n || ')) or b' || n || ' <= port_' || q end as condition
          from (select *, l_linenumber n, cast(trunc(l_quantity) as int) q from lineitem)""")
def conditions_rewired(t):
    return _conditions(t).select("l_orderkey", "l_linenumber", "l_partkey", expressions.renamed("condition", "names").alias("condition"))


@query("""select what, name, count(*) as n from (select unnest(['name', 'name', 'timer_expired', 'in_state']) what, unnest(['a' || l_linenumber, 'b' || l_linenumber, 't' || l_linenumber, 'on' || l_linenumber]) as name from lineitem where l_returnflag <> 'R') group by 1, 2""")
def condition_operands(t):
    return _conditions(t).select(F.inline(expressions.operands("condition"))).groupBy("what", "name").agg(F.count("*").alias("n"))


@query("""select l_linestatus || l_returnflag as state, case when l_returnflag = 'A' then 'start_timer' when l_returnflag = 'N' then 'save_history' end as verb, case when l_returnflag = 'A' then 't' || l_linenumber end as argument, count(*) as n from lineitem group by all""")
def action_parts(t):
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" start_timer( t"), n, F.lit(" )"))).when(F.col("l_returnflag") == "N", F.lit("save_history")).otherwise(F.concat(F.lit("start_timer t"), n))
    read = t.lineitem.select(F.concat("l_linestatus", "l_returnflag").alias("state"), expressions.action(text).alias("a")).select("state", "a.verb", "a.argument")
    return read.groupBy("state", "verb", "argument").agg(F.count("*").alias("n"))


@query("""with u as (select 0 p, o_orderkey o, o_orderstatus as name, null as kind from orders union all select 1, p_partkey, null, p_type from part union all select 2, c_custkey, c_name, c_mktsegment from customer)
          select name, kind, p as pass, row_number() over (order by p, o) as ord from u""")
def passes_united(t):
    orders = t.orders.select(F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("place"))
    parts = t.part.select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("place"))
    return assembly.united([orders, parts, t.customer.select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))], "place")


@query("""with p as (select 's' || s_suppkey id, 'N' || s_nationkey kind, cast(s_acctbal as double) v, s_acctbal > 4000 has, s_nationkey % 3 = 0 d from supplier)
          select 1 as section, id || ' 1' as key, '  ' || kind || ' ' || id || case when has then '(level = ' || v || case when d then ', rate = 0.5' else '' end || ')' when d then '(level = 1.5, rate = 0.5)' else '(level = 1.5)' end || ';' as line from p
          union all select 1, id || ' 0 level', '  // ASSUMPTION (generator default): ' || id || '.level = 1.5' from p where not has union all select 1, id || ' 0 rate', '  // ASSUMPTION (generator default): ' || id || '.rate = 0.5' from p where d
          union all select 2, 'o' || o_orderkey, '  connect(s' || o_custkey || '.out, s' || o_orderkey || '.in);' from orders
          union all select 3, 'c' || c_custkey, case when c_acctbal > 0 then '  assert(level > ' || c_nationkey || ', "c' || c_custkey || ': ' || c_mktsegment || '");' else '  // c' || c_custkey || ' is not asserted: ' || c_mktsegment end from customer
          union all select 0, '', 'model System' union all select 4, '', 'end System;'""")
def class_lines(t):
    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    parts = t.supplier.select(sid.alias("id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("kind"))
    stated = t.supplier.where("s_acctbal > 4000").select(sid.alias("owner"), F.lit("level").alias("name"), F.col("s_acctbal").cast("double").alias("value"))
    wanted = F.array(F.struct(F.lit("level").alias("name"), F.lit(1.5).alias("default")), F.struct(F.lit("rate").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, 0.5).alias("default")))
    required = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("kind"), F.inline(wanted))
    links = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("a_part"), F.lit("out").alias("a_role"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("b_part"), F.lit("in").alias("b_role"))
    condition = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("level > "), F.col("c_nationkey").cast("string")))
    criteria = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), condition.alias("condition"), F.col("c_mktsegment").alias("text"), F.col("c_mktsegment").alias("reason"))
    return render.class_text("System", parts, stated, required, links, criteria)
