"""Queries on text, chunks, profiles and quotes."""

from pyspark.sql import functions as F

from proofline.functions import text as X
from proofline.functions.numbers import parse_value
from proofline.operators import evidence, profile, quotes
from proofline.plans.registry import SQL, query
from proofline.sources import json_tables, published
from proofline.storage import new_path


@query("select doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g') as name_key from documents")
def name_key_documents(t):
    return t.documents.select("doc_id", X.name_key(F.col("text")).alias("name_key"))


@query("select doc_id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') as alias_key from documents")
def alias_key_sources(t):
    return t.documents.select("doc_id", X.alias_key(F.col("source")).alias("alias_key"))


@query("""select p_partkey, case when k in ('all', 'part', 'end') or regexp_matches(k, '^[0-9]') then 'part_' || k else k end as id
          from (select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') k from part)""")
def make_ids(t):
    return t.part.select("p_partkey", X.make_id(F.lit("part"), F.concat_ws(" ", "p_name", "p_brand")).alias("id"))


@query("""select id, count(distinct tag) as tags from (select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') id, p_name || p_type tag from part) group by id having count(distinct tag) > 1""")
def id_collisions(t):
    ids = t.part.select(X.make_id(F.lit("part"), F.col("p_name")).alias("id"), F.concat("p_name", "p_type").alias("tag"))
    return ids.groupBy("id").agg(F.count_distinct("tag").alias("tags")).where("tags > 1")


@query("""select p_partkey, case when regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') then p_name else '''' || p_name || '''' end as name from part""")
def quoted_names(t):
    return t.part.select("p_partkey", X.quoted_name(F.col("p_name")).alias("name"))


BLOCKS = """
    with recursive l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n from documents where text is not null),
    s as (select doc_id, n, length(line) + 1 z from l),
    g as (select doc_id, n, z, z as size, 0 as block from s where n = 0
          union all select s.doc_id, s.n, s.z, case when g.size + s.z > {cap} then s.z else g.size + s.z end, case when g.size + s.z > {cap} then g.block + 1 else g.block end
          from g join s on s.doc_id = g.doc_id and s.n = g.n + 1)
"""


@query(BLOCKS.format(cap=900) + """select g.doc_id, g.block, cast(min(g.n) + 1 as int) as first_line, cast(max(g.n) + 1 as int) as last_line,
          trim(string_agg(l.line, chr(10) order by g.n), chr(10)) as chunk, case when min(g.n) = max(g.n) then 'line ' || (min(g.n) + 1) else 'lines ' || (min(g.n) + 1) || '-' || (max(g.n) + 1) end as locator
          from g join l on l.doc_id = g.doc_id and l.n = g.n group by g.doc_id, g.block having trim(string_agg(l.line, '')) <> ''""")
def chunk_capped_blocks(t):
    return evidence.blocks(t.documents, "doc_id")


@query(SQL["chunk_capped_blocks"])
def chunk_blocks_of_lines(t):
    lines = t.documents.where("text is not null").select("doc_id", F.posexplode(evidence.lines(F.col("text"))).alias("n", "line"))
    return evidence.blocks_of_lines(lines, "doc_id", "n")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n from documents where text is not null),
          r as (select *, sum(case when trim(line) = '' then 1 else 0 end) over (partition by doc_id order by n) run from l),
          p as (select doc_id, run, cast(min(n) + 1 as int) first_line, cast(max(n) + 1 as int) last_line, string_agg(line, chr(10) order by n) chunk from r where trim(line) <> '' group by doc_id, run)
          select doc_id, first_line, last_line, chunk, cast(row_number() over (partition by doc_id order by run) - 1 as int) as paragraph from p""")
def chunk_paragraphs(t):
    return evidence.paragraphs(t.documents, "doc_id")


@query("""select doc_id, source, cast(row_number() over (partition by source order by doc_id) - 1 as int) as pos, source || '#' || (row_number() over (partition by source order by doc_id) - 1) as chunk_id from documents""")
def chunk_positions(t):
    return evidence.chunk_keys(t.documents.select("doc_id", "source"), "source", "doc_id")


@query(BLOCKS.replace("length(line) + 1", "length(line)").format(cap=4000) + """select doc_id, block as batch, cast(min(n) as int) as first_chunk, cast(count(*) as int) as n_chunks, cast(sum(z) as bigint) as n_chars from g group by doc_id, block""")
def batch_documents(t):
    return evidence.batches(t.documents.where("text is not null").select("doc_id", evidence.lines(F.col("text")).alias("chunks")), "doc_id", "chunks")


def _ladder() -> str:
    case = " ".join(f"when {' or '.join(f'contains(h, {chr(39)}{w}{chr(39)})' for w in words)} then '{role}'" for role, words in X.ROLE_RULES + X.LATE_ROLE_RULES)
    reliability = " ".join(f"when '{r}' then '{v}'" for r, v in X.RELIABILITY.items())
    return f"select page_id, role, case role {reliability} end as reliability from (select page_id, case {case} end as role from (select page_id, lower(html) h from pages))"


@query(_ladder())
def classify_pages_keywords(t):
    role = X.keyword_role(F.col("html"))
    return t.pages.select("page_id", role.alias("role")).withColumn("reliability", X.reliability(F.col("role")))


@query(r"""select o_orderkey, nullif(regexp_extract(h, '\bDocument No: ([A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)+)\b', 1), '') as document, nullif(regexp_extract(h, 'Rev\.? ([A-Z0-9][A-Za-z0-9]{0,7})', 1), '') as revision,
           strftime(o_orderdate, '%Y-%m-%d') as date, o_orderpriority as status
           from (select *, 'Document No: ORD-' || o_orderkey || chr(10) || 'Rev. ' || o_orderstatus || '1' h from orders)""")
def header_fields(t):
    o = t.orders
    top = F.concat(F.lit("**Document No:** ORD-"), F.col("o_orderkey").cast("string"), F.lit("\nRev. "), "o_orderstatus", F.lit("1\nDate: "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("\nStatus: "), "o_orderpriority", F.lit("\nbody"))
    return o.select("o_orderkey", X.header(top).alias("h")).select("o_orderkey", "h.*")


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m-%d') as dashed, strftime(o_orderdate, '%Y-%m-%d') as us, 'A' as revision, strftime(o_orderdate, '%Y-%m-%d') as index_date from orders""")
def iso_dates(t):
    d = F.col("o_orderdate")
    iso = [X.iso_date(F.concat(F.lit("seen 9999-99-99, due "), F.date_format(d, f), F.lit(" or later"))).alias(n) for f, n in (("yyyy-MM-dd", "iso"), ("d-MMM-yyyy", "dashed"), ("MMMM d, yyyy", "us"))]
    cell = X.index_revision(F.concat(F.lit("Rev A / "), F.date_format(d, "yyyy-MM-dd")))
    return t.orders.select("o_orderkey", *iso, cell["revision"].alias("revision"), cell["date"].alias("index_date"))


@query("select conv_id, turn, cast(row_number() over (partition by conv_id order by turn desc nulls last, text) as int) as rank from conversations")
def thread_newest_first(t):
    return evidence.newest_first(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text").drop("text")


def _profile_sql(column: str) -> str:
    place = "(l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    return f"select '{column}' as column, min({column}) as min, max({column}) as max, arg_min({column}, {place}) as first, arg_max({column}, {place}) as last from lineitem"


@query(" union all ".join(_profile_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_numeric(t):
    return profile.numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""with e as (select user_id, props, min(event_id) seen from events group by user_id, props), n as (select *, row_number() over (partition by user_id order by seen) n, count(*) over (partition by user_id) c from e)
          select user_id, c as n_distinct, string_agg(props, ', ' order by n) filter (where n <= 12) as shown, greatest(c - 12, 0) as more from n group by user_id, c""")
def profile_text_first_seen(t):
    return profile.first_seen(t.events, ["user_id"], "props", "event_id")


@query("select min(l_shipdate) as start, max(l_shipdate) as end, count(*) as rows from lineitem")
def profile_time_span(t):
    return profile.time_span(t.lineitem, "l_shipdate")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n from documents where text is not null),
          c as (select doc_id, n, len(string_split(line, ',')) c from l), h as (select doc_id, c head from c where n = 0)
          select doc_id, count(*) as rows, count(*) filter (where c <> head) as ragged from c join h using (doc_id) group by doc_id""")
def profile_ragged(t):
    rows = t.documents.where("text is not null").select("doc_id", F.posexplode(evidence.lines(F.col("text"))).alias("n", "line")).select("doc_id", "n", F.split("line", ",").alias("cells"))
    return profile.ragged(rows, "doc_id", "cells")


@query("select event_type, bool_and(try_cast(json_extract_string(props, '$.k') as double) is not null) as k_is_numeric, bool_and(try_cast(event_type as double) is not null) as type_is_numeric from events group by event_type")
def profile_column_types(t):
    return t.events.groupBy("event_type").agg(profile.is_numeric(F.get_json_object("props", "$.k")).alias("k_is_numeric"), profile.is_numeric(F.col("event_type")).alias("type_is_numeric"))


@query("select event_id, '$.k' as path, json_extract_string(props, '$.k') as value from events")
def json_props(t):
    v = F.call_function("try_parse_json", F.col("props"))
    kids = t.events.select("event_id", v.alias("v")).lateralJoin(t.spark.tvf.variant_explode(F.col("v").outer()))
    return kids.select("event_id", F.concat(F.lit("$."), F.col("key")).alias("path"), F.col("value").cast("string").alias("value"))


@query("""with e as (select user_id u, list('{"id": ' || event_id || ', "type": "' || event_type || '"}' order by event_id) l, sum(length(event_id::varchar) + length(event_type) + 20) + 2 * count(*) n from events group by 1)
          select u as user_id, '$.user' as path, u::varchar as text, cast(null as varchar) as kind from e union all select u, '$.events', '[' || array_to_string(l, ', ') || ']', null from e where n <= 900
          union all select u, '$.events[' || i || ']', l[i + 1], regexp_extract(l[i + 1], '"type": "(.*)"', 1) from (select u, l, unnest(range(len(l))) i from e where n > 900)""")
def json_records(t):
    each = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))))
    texts = t.events.groupBy("user_id").agg(F.to_json(F.struct(F.col("user_id").alias("user"), each.alias("events"))).alias("text"))
    return json_tables.records(texts, "user_id").select("user_id", "path", "text", F.col("fields")["type"].alias("kind"))


@query("""select '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' as value from customer""")
def published_lines(t):
    path = new_path(t.spark, "published")
    published.publish(t.customer.select("c_mktsegment", "c_custkey"), path, ["c_custkey"])
    return published.published(t.spark, path).select("value")


@query("select o_orderpriority || ' ' || o_custkey as key, case when count(*) filter (where o_orderstatus <> 'F') > 0 then min(o_orderkey::varchar) filter (where o_orderstatus <> 'F') else min(o_orderkey::varchar) end as value from orders group by 1")
def cache_first_writer(t):
    path, key = new_path(t.spark, "cache"), F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("k")
    published.put(t.orders.where("o_orderstatus <> 'F'").select(key, "o_orderkey"), path, "k", "o_orderkey")
    published.put(t.orders.select(key, "o_orderkey"), path, "k", "o_orderkey")
    return published.cached(t.spark, path)


@query("select doc_id, sha256(to_json([text, lang, source])::varchar) as key from documents")
def content_hash(t):
    return t.documents.select("doc_id", X.content_key(F.col("text"), F.col("lang"), F.col("source")).alias("key"))


FRAGMENTS = """with n as (select count(*) c from documents), f as (select doc_id as fragment, case when doc_id % 3 = 0 then doc_id + 1 else doc_id end as chunk_id, string_split(text, chr(10))[1] as quote from documents)"""


@query(FRAGMENTS + r"""select f.fragment, f.chunk_id, case when r is not null then 'discarded' when contains(text, quote) then 'exact' else 'collapsed' end as status, r as reason
       from (select f.*, d.text, case when d.doc_id is null then 'no such chunk' when trim(quote) = '' then 'empty quote' when length(quote) > 300 then 'quote too long' when contains(d.text, quote) then null
             when contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) then null else 'quote not in the chunk' end r
             from f left join documents d on d.doc_id = f.chunk_id) f""")
def verify_quotes(t):
    d = t.documents
    cited = d.select(F.col("doc_id").alias("fragment"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("chunk_id"), F.get(evidence.lines(F.col("text")), F.lit(0)).alias("quote"))
    return quotes.verify(cited, d.select(F.col("doc_id").alias("chunk_id"), "text")).drop("quote")


@query(r"""select b.item_id as quote_id, d.doc_id as chunk_id from benchmark b join documents d on contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))""")
def quote_occurrences(t):
    return quotes.occurrences(t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))


@query(r"""select b.item_id as quote_id, min(d.doc_id) as chunk_id from benchmark b join documents d on contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))
           group by b.item_id having count(distinct d.doc_id) = 1""")
def quote_unique_home(t):
    return quotes.only_home(quote_occurrences(t))


@query(r"""select n_name as name, count(*) as parts from (select distinct n_name, p_partkey from nation, (select p_partkey, p_name || ' NATION_' || p_size || ' x' text from part) where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || n_name || '([^A-Za-z0-9]|$)')) group by 1""")
def mentions_whole_token(t):
    texts = t.part.select("p_partkey", F.concat("p_name", F.lit(" NATION_"), F.col("p_size").cast("string"), F.lit(" x")).alias("text"))
    return quotes.named(texts, t.nation.select(F.col("n_name").alias("name"))).groupBy("name").agg(F.count("*").alias("parts"))


@query("select doc_id, case when length(text) <= 40 then text else rtrim(substr(text, 1, 39)) || '…' end as clipped from documents")
def clipped_texts(t):
    return t.documents.select("doc_id", X.clip(F.col("text"), 40).alias("clipped"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '\|', '\\|', 'g')) as cell from documents")
def markdown_cells(t):
    return t.documents.select("doc_id", X.markdown_cell(F.col("text")).alias("cell"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity * 60 + 3600 as seconds, [-l_extendedprice] as value from lineitem")
def clock_and_values(t):
    q = F.col("l_quantity").cast("int")
    clock = F.concat(F.lit("01:"), F.lpad(q.cast("string"), 2, "0"))
    value = parse_value(F.concat(F.lit("− ").substr(1, 1), F.regexp_replace(F.format_number("l_extendedprice", 2), " ", ""), F.lit(" ± 5")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.clock_seconds(clock).alias("seconds"), value.alias("value"))


@query("select c_custkey, 'name: ' || c_name || ' | column 2: ' || c_mktsegment || ' | name'': ' || c_nationkey as text from customer")
def row_fields_text(t):
    fields = X.row_fields(F.array(F.lit("name"), F.lit(""), F.lit("name"), F.lit("empty")), F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("")))
    return t.customer.select("c_custkey", X.fields_text(fields).alias("text"))
