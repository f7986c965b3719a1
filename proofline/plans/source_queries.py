"""Queries that read files made of whole tables, write and read tables, and apply functions of text and time."""

from pyspark.sql import functions as F

from proofline.functions import numbers
from proofline.functions import text as X
from proofline.operators import evidence, gates, graph, model, render, report, series, skew
from proofline.plans.registry import query
from proofline.sources import readers, tables
from proofline.storage import new_path


def text(column):
    return F.col(column).cast("string")


def _files(df, key, suffix, content):
    """Files (path, content, source_id) of a table's rows."""
    return df.select(F.concat(F.lit("in/"), text(key), F.lit(suffix)).alias("path"), F.encode(content, "utf-8").alias("content"), text(key).alias("source_id"))


@query(r"""select cast(doc_id as varchar) as source_id, 'text' as format, length(regexp_replace(text, '\s', '', 'g')) as letters from documents where regexp_replace(text, '\s', '', 'g') <> ''""")
def read_text_files(t):
    rows = readers.chunk_rows(_files(t.documents.where("text is not null"), "doc_id", ".txt", F.col("text"))).where("status = 'read'")
    return rows.groupBy("source_id", "format").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters"))


@query("select cast(event_id as varchar) as source_id, 'k' as k, json_extract_string(props, '$.k') as v from events")
def read_json_files(t):
    rows = readers.chunk_rows(_files(t.events, "event_id", ".json", F.concat(F.lit('{"props": '), "props", F.lit("}"))))
    return rows.select("source_id", F.explode("fields").alias("f")).select("source_id", "f.k", "f.v")


@query("select cast(c_nationkey as varchar) as source_id, 'rows: ' || count(*) as line from customer group by 1 union all select cast(c_nationkey as varchar), 'column segment: text, ' || count(distinct c_mktsegment) || ' distinct' from customer group by 1")
def read_csv_files(t):
    line = F.concat_ws(",", text("c_custkey"), "c_mktsegment")
    files = t.customer.groupBy("c_nationkey").agg(F.concat(F.lit("time_s,segment\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("csv"))
    rows = readers.chunk_rows(_files(files, "c_nationkey", ".csv", F.col("csv"))).select("source_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where("line like 'rows: %' or line like 'column segment%'").select("source_id", F.regexp_extract("line", "^[^:]*: [^:]*", 0).alias("line"))


@query("""select cast(o_orderkey as varchar) as source_id, 'Order of ' || o_custkey as subject, 'Status ' || o_orderstatus || ' now.' as text, 1 as message from orders
          union all select cast(o_orderkey as varchar), 'Order of ' || o_custkey, 'Older: ' || o_orderpriority, 2 from orders""")
def read_mail_files(t):
    mail = F.concat(F.lit("From: a@x\nTo: b@x\nSubject: Order of "), text("o_custkey"), F.lit("\nDate: Mon, 02 Mar 2026 10:00:00 +0000\n\nStatus "), "o_orderstatus", F.lit(" now.\n\n-----Original Message-----\nFrom: c@x\n\nOlder: "), "o_orderpriority", F.lit("\n"))
    rows = readers.chunk_rows(_files(skew.spread(t.orders, "o_orderkey"), "o_orderkey", ".eml", mail))
    return rows.select("source_id", F.col("title").alias("subject"), "text", F.regexp_extract("locator", "message ([0-9]+)", 1).cast("int").alias("message"))


@query("""select cast(p_partkey as varchar) as source_id, k as kind, x as text from (select p_partkey, 'heading' k, '# ' || p_name x from part union all select p_partkey, 'paragraph', 'Size ' || p_size from part
          union all select p_partkey, 'list_item', '- ' || p_brand from part union all select p_partkey, 'table_row', 'A: ' || p_type || ' | B: 1' from part)""")
def read_markdown_files(t):
    md = F.concat(F.lit("# "), "p_name", F.lit("\n\nSize "), text("p_size"), F.lit("\n\n- "), "p_brand", F.lit("\n\n| A | B |\n|---|---|\n| "), "p_type", F.lit(" | 1 |\n"))
    return readers.chunk_rows(_files(skew.spread(t.part, "p_partkey"), "p_partkey", ".md", md)).select("source_id", "kind", "text")


@query("select n_name as line from nation")
def scan_folder(t):
    path = new_path(t.spark, "scan")
    t.nation.select("n_name").write.text(f"{path}/in")
    return readers.scan(t.spark, f"{path}/in").where("format = 'text'").select(F.explode(F.split("text", "\n")).alias("line"))


@query("select 'read' as status, count(*) as sources from documents where text is not null and trim(text) <> '' union all select 'unread', count(*) from region")
def source_status_counts(t):
    files = _files(t.documents.where("trim(text) <> ''"), "doc_id", ".txt", F.col("text")).union(_files(t.region, "r_name", ".png", F.lit("no text")))
    return readers.sources(readers.chunk_rows(files)).groupBy("status").agg(F.count("*").alias("sources"))


@query("select cast(user_id as varchar) as t, 'value' as series, round(value, 2) as value from events")
def trace_of_csv(t):
    path = new_path(t.spark, "trace")
    t.events.select(F.col("user_id").alias("time_s"), F.round("value", 2).alias("value")).write.option("header", True).csv(path)
    return tables.trace(t.spark, path).select(F.col("t").cast("long").cast("string").alias("t"), "series", "value")


@query("select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as owner, o_orderstatus as initial from orders")
def model_table_of_json(t):
    path = new_path(t.spark, "machines")
    t.orders.select(text("o_orderkey").alias("id"), text("o_custkey").alias("owner"), F.col("o_orderstatus").alias("initial")).write.json(path)
    return tables.read_table(t.spark, path, "machines").select("id", "owner", "initial")


@query("""select 'notes.txt' as name, 'loaded' as state, null as reason, sum(length(c_name) + 1)::bigint as chars from customer union all select 'log.json', 'invalid', 'not valid JSON', null from supplier where s_suppkey = (select min(s_suppkey) from supplier)
          union all select 'model.json', 'loaded', null, sum(length('{"id":' || p_partkey || ',"kind":"' || p_type || '"},'))::bigint + 2 from part union all select 'plot.txt', 'missing', 'not written by this run', null from region where r_regionkey = 0""")
def run_artefacts(t):
    path = new_path(t.spark, "run")
    each = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))))
    tables.write_lines(t.part.agg(F.to_json(each).alias("line")), f"{path}/model.json", ["line"])
    tables.write_lines(t.supplier.select("s_suppkey", F.concat(F.lit("{"), "s_name").alias("line")), f"{path}/log.json", ["s_suppkey"])
    tables.write_lines(t.customer.select("c_custkey", F.col("c_name").alias("line")), f"{path}/notes.txt", ["c_custkey"])
    found = tables.load_run(t.spark, path, ["notes.txt", "model.json", "log.json", "plot.txt"])
    return found.select("name", "state", "reason", F.length("text").cast("long").alias("chars"))


@query("select event_id, date_trunc('minute', ts) as at from events")
def mail_dates(t):
    return t.events.select("event_id", X.mail_date(F.date_format("ts", "EEEE, MMMM d, yyyy H:mm")).cast("timestamp_ntz").alias("at"))


@query("select o_orderkey, 'key sk-*** for ' || o_custkey as text from orders")
def redacted(t):
    return t.orders.select("o_orderkey", X.redact(F.concat(F.lit("key sk-"), F.lpad(text("o_orderkey"), 12, "0"), F.lit(" for "), text("o_custkey"))).alias("text"))


@query("""select p_partkey, upper(p_name[1]) || regexp_extract(p_name, '^.([^ ]*)', 1) || upper(regexp_extract(p_name, ' (.)', 1)) || regexp_extract(p_name, ' .(.*)$', 1) as package, '"' || replace(p_brand, '#', '\\"') || '"' as literal from part""")
def package_names(t):
    return t.part.select("p_partkey", X.package_name(F.col("p_name")).alias("package"), X.string_literal(F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit('"')), F.lit(" \n"))).alias("literal"))


@query("select p_partkey, cast(cast(p_size as varchar) as varchar) as whole, cast(p_size / 4.0 as double) as quarter from part")
def shortest_numbers(t):
    return t.part.select("p_partkey", X.shortest_number(F.col("p_size").cast("double")).alias("whole"), X.shortest_number(F.col("p_size") / 4).cast("double").alias("quarter"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity = l_linenumber or l_linenumber = 3 or l_quantity = 3 as states from lineitem")
def states_number(t):
    said = F.concat(F.lit("after "), text("l_linenumber"), F.lit(".0 s and 3 s, T7"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.states_number(said, F.when(F.col("l_linenumber") == 3, 3.0).otherwise(F.col("l_quantity"))).alias("states"))


@query("select event_id, max(case when event_type = 'view' then event_id end) over (partition by user_id order by event_id) as heading from events")
def headings(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("event_id")).alias("title"))
    return evidence.headings(rows, "user_id", "event_id", "title").select("event_id", F.col("section").alias("heading"))


@query("""select l_returnflag || l_linestatus || l_linenumber as text, list_sort(list(distinct l_suppkey)) as affects, row_number() over (order by min(l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey)) as number from lineitem group by 1""")
def stated_assumptions(t):
    hints = t.lineitem.select(F.concat("l_returnflag", "l_linestatus", text("l_linenumber")).alias("text"), F.array("l_suppkey").alias("affects"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"))
    return gates.stated_assumptions(hints).select("text", "affects", "number")


@query("select o_custkey as conflict, o_totalprice as value from orders where o_totalprice > 300000")
def winners(t):
    rows = t.orders.select(F.col("o_custkey").alias("conflict"), F.col("o_totalprice").alias("value"), F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("resolution"))
    return model.winners(rows).drop("resolution")


@query("""with a as (select user_id series, max(event_id) x from events group by 1), b as (select user_id series, max(event_id) y from events where value < 100 group by 1)
          select series, cast(x as double) as reference_end, cast(y as double) as run_end from a join b using (series) where y < x - 50""")
def early_stops(t):
    rows = t.events.select(F.col("user_id").alias("series"), F.col("event_id").cast("double").alias("t"), "value")
    return series.early_stop(rows, rows.where("value < 100"), 50.0)


@query("""with l as (select user_id s, event_id n, event_type x from events), m as (select *, sum((x = 'error')::int) over (partition by s order by n) k from l) select s as source, k as message, string_agg(x, chr(10) order by n) as text from m where k > 0 group by 1, 2""")
def message_blocks(t):
    return report.message_blocks(t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("n"), F.col("event_type").alias("line")), "^error")


@query("""select case when c_custkey % 3 = 0 then 'state' else 'continuous' end as kind, case when c_custkey % 3 = 0 then c_mktsegment when c_nationkey > 20 then '-' else 'u' || c_nationkey end as "group", list_sort(list(distinct c_name)) as names from customer group by 1, 2""")
def signal_groups(t):
    kind = F.when(F.col("c_custkey") % 3 == 0, "state").otherwise("continuous")
    return series.signal_groups(t.customer.select(F.col("c_name").alias("name"), kind.alias("kind"), F.when(F.col("c_nationkey") <= 20, F.concat(F.lit("u"), text("c_nationkey"))).alias("unit"), F.col("c_mktsegment").alias("machine")))


@query("""with e as (select distinct s_nationkey a, 100 + p_size b from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey), f as (select distinct b a, b + 100 b from e where b - 100 in (select c_nationkey from customer))
          select distinct a as node, 0 as "column" from e union all select distinct b, 1 from e union all select b, 2 from f""")
def layout_columns(t):
    sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    first = sold.select(F.col("s_nationkey").alias("a"), (F.col("p_size") + 100).alias("b")).distinct()
    second = first.select((F.col("b") - 100).alias("c_nationkey")).join(t.customer, "c_nationkey", "left_semi").select((F.col("c_nationkey") + 100).alias("a"), (F.col("c_nationkey") + 200).alias("b")).distinct()
    links = first.union(second)
    return graph.columns(links, links.select(F.col("a").alias("node")).union(links.select("b")).distinct())


@query("""select o_custkey as machine, '    entry' as part, count(distinct o_orderstatus) as states from orders group by 1""")
def region_lines(t):
    regions = t.orders.groupBy(text("o_custkey").alias("machine")).agg(F.lit("r").alias("id"), F.lit("all").alias("name"), F.min("o_orderstatus").alias("initial"), F.collect_set("o_orderstatus").alias("states"))
    lines = render.region_text(regions).where(F.col("line").rlike("^ {8}state "))
    return lines.groupBy(F.split("key", " ")[0].cast("long").alias("machine")).agg(F.count("*").alias("states")).select("machine", F.lit("    entry").alias("part"), "states")


@query("""with b as (select s_nationkey m, s_name n, case when s_acctbal > 0 then 'sys.' || s_suppkey end p from supplier)
          select 'm' || m || ' 0' as key, '    exhibit state m' || m || ' {' || case when count(*) filter (where p is null) > 0 then ' doc /* unbound: ' || string_agg(n, '; ' order by n) filter (where p is null) || ' */' else '' end as line from b group by m
          union all select 'm' || m || ' 1 ' || n, '        in :>> ''' || n || ''' = ' || p || ';' from b where p is not null union all select distinct 'm' || m || ' 2', '    }' from b""")
def exhibit_lines(t):
    bindings = t.supplier.select(F.concat(F.lit("m"), text("s_nationkey")).alias("machine"), F.lit("o").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("sys."), text("s_suppkey"))).alias("path"), F.lit("in").alias("way"))
    return render.exhibit_text(bindings).drop("section")


@query("""with t as (select s_nationkey m, 's' || s_suppkey % 3 f, s_suppkey p, row_number() over (partition by s_nationkey, s_suppkey % 3 order by s_suppkey) n from supplier), f as (select distinct m, f from t)
          select m as machine, 4 as section, f || ' ' || printf('%06d', n) as key, case when n = 1 then '      if ' else '      elseif ' end || 'c' || p || ' then state := State.s' || (p + 1) % 3 || ';' as line from t
          union all select m, 4, f || ' 000000', case when f = min(f) over (partition by m) then '    if ' else '    elseif ' end || 'pre(state) == State.' || f || ' then' from f union all select m, 4, f || ' 999999', '      end if;' from f
          union all select distinct m, 5, '', '    end if;' from t
          union all select n_nationkey, s, '', l from nation, lateral (values (0, 'block Controller_' || n_nationkey), (1, '  type State = enumeration(s0 "n0", s1 "n1", s2 "n2");'), (2, '  State state(start = State.s0, fixed = true);'), (3, 'algorithm'), (6, 'end Controller_' || n_nationkey || ';')) v(s, l)""")
def controller_lines(t):
    states = t.nation.select(F.col("n_nationkey").alias("machine"), F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"s{i}").alias("state"), F.lit(f"n{i}").alias("name")) for i in range(3)))).alias("x")).select("machine", "x.*")
    k = F.col("s_suppkey")
    transitions = t.supplier.select(F.col("s_nationkey").alias("machine"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("from_state"), F.concat(F.lit("s"), ((k + 1) % 3).cast("string")).alias("to_state"), F.concat(F.lit("c"), k.cast("string")).alias("condition"), k.alias("priority"))
    return render.controller_text(states, transitions)


TIMED = """
    with k as (select s_nationkey m, s_suppkey k, 's' || s_suppkey % 3 f, case when s_suppkey % 5 = 0 then 'history' else 's' || (s_suppkey + 1) % 3 end t, s_suppkey % 4 a from supplier),
    own as (select distinct m, t st, 't1' x from k where a = 1 and t <> 'history' union select n_nationkey, 's1', 't2' from nation), cnt as (select m, st, list(x || '_remaining := ' || x || '_deadline - time;' order by x) l from own group by 1, 2),
    fro as (select distinct own.m, x from own join k on k.m = own.m and k.f = st and a = 0),
    ret as (select m, list('if history == State.' || st || ' then ' || l || ' end if;' order by st) r from (select m, st, string_agg(x || '_deadline := time + ' || x || '_remaining;', ' ' order by x) l from own join fro using (m, x) group by 1, 2) group by m),
    ln as (select k.m, k, ['// ' || k || ': n' || f[2:2] || ' -> ' || case when t = 'history' then t else 'n' || t[2:2] end] || case a when 0 then ['history := State.' || f || ';'] || coalesce(l, []) when 1 then ['t1_deadline := time + d1;', 'history := State.s0;'] else [] end
                  || case when t = 'history' then ['state := history;'] || coalesce(r, []) else ['state := State.' || t || ';'] || case when t = 's1' then ['t2_deadline := time + d2;'] else [] end end x
           from k left join cnt on cnt.m = k.m and st = f left join ret on ret.m = k.m)
"""


def _timed(t):
    nation, k = t.nation.select(F.col("n_nationkey").alias("machine")), F.col("s_suppkey")
    none = F.expr("cast(array() as array<string>)")
    states = nation.select("machine", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"s{i}").alias("state"), F.lit(f"n{i}").alias("name"), F.array(F.lit("start_timer(t2)")).alias("actions") if i == 1 else none.alias("actions")) for i in range(3)))))
    actions = F.when(k % 4 == 0, F.array(F.lit("save_history"))).when(k % 4 == 1, F.array(F.lit("start_timer( t1 )"), F.lit("clear_history"))).otherwise(none)
    to = F.when(k % 5 == 0, "history").otherwise(F.concat(F.lit("s"), ((k + 1) % 3).cast("string")))
    transitions = t.supplier.select(F.col("s_nationkey").alias("machine"), k.alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("from_state"), to.alias("to_state"), actions.alias("actions"))
    timers = nation.select("machine", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"t{i}").alias("timer"), F.lit(f"d{i}").alias("duration")) for i in (1, 2, 3)))))
    return render.controller_timers(states, transitions, timers)


@query(TIMED + "select m as machine, k as id, cast(i - 1 as int) as n, x[i] as line from (select *, unnest(range(1, len(x) + 1)) i from ln)")
def controller_statements(t):
    return _timed(t)[0]


@query(TIMED + """select n_nationkey as machine, n, line from nation, lateral (
       select 0 n, 'State history(start = State.s0, fixed = true);' as line where exists (select 1 from k where m = n_nationkey and (a in (0, 1) or t = 'history')) union all
       select 3, case when exists (select 1 from k where m = n_nationkey and a = 1) then 'discrete Real t1_deadline(start = Modelica.Constants.inf, fixed = true);' else 'parameter Real t1_deadline = Modelica.Constants.inf;' end union all
       select 5, 'discrete Real t2_deadline(start = Modelica.Constants.inf, fixed = true);' union all select 7, 'parameter Real t3_deadline = Modelica.Constants.inf;' union all
       select case x when 't1' then 4 else 6 end, 'discrete Real ' || x || '_remaining(start = 0, fixed = true);' from fro where m = n_nationkey)""")
def controller_declarations(t):
    return _timed(t)[1]


@query("""select p_partkey, 'model M' || p_partkey || chr(10) || '  import SI = Modelica.Units.SI;' || chr(10) || '  Real final_(unit = "m2");' || chr(10) || '  Real y = final_.x;' || chr(10) || 'end M;' as text from part""")
def text_fixes(t):
    source = F.concat(F.lit("model M"), text("p_partkey"), F.lit('\n  Real final(unit = "m^2");\n  Real y = final.x;\nend M;'))
    messages = F.concat(F.lit("Class SI.Length not found in scope P.M"), text("p_partkey"), F.lit(".\nNo viable alternative near token: final\nInvalid unit expression 'm^2'"))
    rows = skew.spread(t.part.select("p_partkey"), "p_partkey").select("p_partkey", source.alias("text"), messages.alias("messages"))
    imported = rows.withColumn("text", render.import_fixes("text", "messages")).withColumn("text", render.reserved_name_fixes("text", "messages"))
    return imported.select("p_partkey", render.unit_fixes(F.col("text"), F.col("messages")).alias("text"))
