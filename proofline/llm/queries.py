"""Queries opN_<name> over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import bpe, centroids, html_text, knn, packing, quality_rules, ranking, secrets, shingle_join, sstable, substring_dedup, warc, whitening
from proofline.llm._common import documents, table


def op1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ranking.score(docs, ranking.fit(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), "word_bpe_49k.json", hashes_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url", "payload")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir), words=51)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs.select("doc_id", "text"), model).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), "word_bpe_49k.json").drop("ids")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(documents(spark, sf_dir), "byte_bpe_50k.json")).drop("ids")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of op11's fit list and its exact deviations, which SQL can express."""
    return op11_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4's base patterns, which SQL can express."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def lloyd_sql(rounds: int) -> str:
    """The rounds of op12 one after the other: assignments a, sums s, centroids c."""
    whole = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    parts = [
        f"v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings where {whole})",
        "c0 as materialized (select cast(row_number() over (order by sha256('2:' || vec_id)) - 1 as integer) c, q from v where vec_id is not null order by c limit 40)",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} as materialized (select rid, c, d from (select rid, c, cast(list_sum(list_transform(list_zip(v.q, c{n}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) d from v, c{n})
                qualify row_number() over (partition by rid order by d, c) = 1)"""
        )
        parts.append(f"s{n} as (select c, i, sum(x) s, count(*) n from (select c, unnest(range(1, 65)) i, unnest(q) x from a{n} join v using (rid)) group by c, i)")
        parts.append(f"c{n + 1} as materialized (select c, coalesce(m.q, o.q) q from c{n} o left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) q from s{n} group by c) m using (c))")
    return f"""
        with {", ".join(parts)}
        select vec_id, c as "cluster", d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.q, ',')) as centroid_sha256
        from a{rounds} join v using (rid) join c{rounds} using (c)"""


WORD = "[^\\x20\\x09-\\x0D]"
LOWER = ("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
SQL = {
    "base_quality_counts": f"""
        with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}+') ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) ls from documents),
             g as (select doc_id, unnest(range(1, len(ws) - 1)) i, unnest([ws[i:i + 2] for i in range(1, len(ws) - 1)]) x from w),
             r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) n from g) where n > 1),
             c as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from r) group by 1)
        select w.doc_id, len(ws) as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
               coalesce(n, 0) as n_repeat_words, len(ws) < 50 or 100 * coalesce(n, 0) > 50 * len(ws) as base_failed from w left join c on c.doc_id = w.doc_id""",
    "op12_centroids": lloyd_sql(5),
    "base_whitening": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings
                   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             f as (select distinct q from v), n as (select count(*) n from f),
             s as (select list(s order by i) s from (select i, cast(sum(x) as bigint) s from (select unnest(range(1, len(q) + 1)) i, unnest(q) x from f) group by i))
        select vec_id, n, cast(list_sum(list_transform(list_zip(q, s), lambda z: (n * z[1] - z[2]) * (n * z[1] - z[2]))) as bigint) as deviation from v, n, s""",
    "base_secret_counts": r"""
        select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as n_assign,
               len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex from documents""",
    "op3_warc": """
        with d as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) x from pages),
             b as (select *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1 as int), 1) for i in range(32)], '') digest,
                   max(page_id) over (partition by x) keeper from d)
        select page_id, n as payload_bytes, digest as payload_digest, case when page_id = keeper then 'response' else 'revisit' end as record_type, case when page_id <> keeper then keeper end as refers_to from b""",
    "op10_shingle_join": f"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{LOWER[0]}', '{LOWER[1]}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
             s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct([hash(array_to_string(ws[i:i + 4], ' ')) for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [hash(array_to_string(ws, ' '))] else [] end) sh from w),
             n as (select doc_id, count(*) c from s group by 1),
             p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
             l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.c + y.c - i)),
             r as (select doc_id node, doc_id root from w union select l.b, r.root from r join l on l.a = r.node where r.root < l.b)
        select w.doc_id, coalesce(n.c, 0) as n_shingles, min(r.root) as component_id from w left join n on n.doc_id = w.doc_id join r on r.node = w.doc_id group by 1, 2""",
    "op5_knn": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) q from embeddings
                   where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select a.vec_id query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) score
                   from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
             r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 10""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(("op", "base_")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return SQL
