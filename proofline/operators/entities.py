"""Entities from fragments that name them: formal tags, links between names, election of tag, kind, attributes and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import name_key

FORMAL = "^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$"  # a formal tag such as AB-12


def is_formal(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(FORMAL), F.lit(False))


def linked_names(names: Column) -> Column:
    """The names that one fragment joins: all, or its first and the informal ones if it lists several formal tags."""
    formal = F.array_distinct(F.filter(names, is_formal))
    rest = F.filter(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda n: ~is_formal(n))
    return F.when(F.size(formal) <= 1, names).otherwise(F.concat(F.slice(names, 1, 1), rest))


def edges(fragments: DataFrame) -> DataFrame:
    """fragments(ord, names array) to links(a, b, ord) from a fragment's first name to each of its others, by their keys."""
    keyed = fragments.select("ord", F.posexplode(linked_names(F.col("names"))).alias("i", "name")).withColumn("key", name_key(F.col("name"))).where("key <> ''")
    first = keyed.groupBy("ord").agg(F.min_by("key", "i").alias("a"))
    return keyed.join(first, "ord").select("a", F.col("key").alias("b"), F.format_string("%018d.%06d", F.col("ord").cast("long"), F.col("i")).alias("ord"))


def canonical(names: DataFrame) -> DataFrame:
    """names(entity, name, rank, ord): the best-ranked formal tag, else the best-ranked name."""
    return names.groupBy("entity").agg(F.min_by("name", F.struct((~is_formal(F.col("name"))).alias("informal"), "rank", "ord")).alias("tag"))


def attributes(rows: DataFrame) -> DataFrame:
    """rows(entity, key, value, rank, ord): each attribute's first value in order of authority, as an array of (k, v)."""
    first = rows.groupBy("entity", "key").agg(F.min_by("value", F.struct("rank", "ord")).alias("value"))
    return first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), F.col("value").alias("v")))).alias("attributes"))


def traces(rows: DataFrame) -> DataFrame:
    """rows(entity, source_id, locator, quote): distinct traces in order."""
    return rows.groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("source_id", "locator", "quote"))).alias("trace"))


def glossary(rows: DataFrame) -> DataFrame:
    """rows(key, tag, kind, alias, ord): first tag and kind of a key, and its aliases as first seen."""
    each = rows.groupBy("key", "alias").agg(F.min("ord").alias("seen"), F.min_by("tag", "ord").alias("tag"), F.min_by("kind", "ord").alias("kind"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seen", "alias"))), lambda x: x["alias"])
    return each.groupBy("key").agg(F.min_by("tag", "seen").alias("tag"), F.min_by("kind", "seen").alias("kind"), listed.alias("aliases"))


def registry(stated: DataFrame, cited: DataFrame) -> DataFrame:
    """Documents by key: those on file first (the first of a key wins), then those that are only cited. Both have key, title, ord."""
    known = stated.groupBy("key").agg(F.min_by("title", "ord").alias("title")).withColumn("absent", F.lit(False))
    missing = cited.join(known, "key", "left_anti").groupBy("key").agg(F.min_by("title", "ord").alias("title")).withColumn("absent", F.lit(True))
    return known.unionByName(missing)


def cited_document(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations(id, key) to documents(key): by the key, else by the key without a revision at its end."""
    d = documents.select("key")
    exact = d.select(F.col("key"), F.col("key").alias("hit"))
    bare = d.select(F.col("key").alias("bare"), F.col("key").alias("bare_hit"))
    return citations.withColumn("bare", F.regexp_replace("key", "(rev|revision)[a-z0-9]{1,3}$", "")).join(exact, "key", "left").join(bare, "bare", "left").select("id", "key", F.coalesce("hit", "bare_hit").alias("document"))


def free_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Ids with a counter from the second holder of a base on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("free_id", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), n.cast("string"))))


def measured_part(inputs: DataFrame, parts: DataFrame) -> DataFrame:
    """inputs(input, kind, text) to the parts(part, kind, name) of the kind that their text mentions: a link if it is one, a question if several, missing if none.

    Equal texts and equal names meet once, and a name stands for all parts that bear it.
    """
    from proofline.operators.quotes import named

    held = parts.groupBy("kind", "name").agg(F.count_distinct("part").alias("n"), F.min("part").alias("a"), F.max("part").alias("b"))
    told = F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")
    asked = inputs.select("input", F.col("kind").alias("wanted"), "text")
    texts = named(asked.select("wanted", "text").distinct(), held).where("kind = wanted").groupBy("wanted", "text").agg(*told)
    hits = asked.join(texts, ["wanted", "text"]).groupBy("input").agg(*told)
    one, several = (F.col("n") == 1) & (F.col("a") == F.col("b")), (F.col("n") > 1) | (F.col("a") != F.col("b"))
    return inputs.select("input").distinct().join(hits, "input", "left").select("input", F.when(one, "link").when(several, "question").otherwise("missing").alias("outcome"), F.when(one, F.col("a")).alias("part"))
