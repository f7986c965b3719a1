"""Evidence: is a quote in the chunk that it cites, where else does it stand, and which names does a text mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import mentions

MAX_QUOTE = 300
ANCHOR = 4
BROADCAST_ROWS = 1_000_000  # of 8 bytes


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def verify(fragments: DataFrame, chunks: DataFrame) -> DataFrame:
    """`fragments(chunk_id, quote)` with status (exact, collapsed or discarded) and reason, by a join on the cited chunk."""
    joined = fragments.join(chunks.select("chunk_id", F.col("text").alias("chunk_text"), F.lit(True).alias("known")), "chunk_id", "left")
    quote, text = F.col("quote"), F.col("chunk_text")
    reason = (
        F.when(F.col("known").isNull(), "no such chunk").when(collapsed(quote).isNull() | (collapsed(quote) == ""), "empty quote").when(F.length(quote) > MAX_QUOTE, "quote too long").when(text.contains(quote), None)
        .when(collapsed(text).contains(collapsed(quote)), None).otherwise("quote not in the chunk")
    )
    status = F.when(reason.isNotNull(), "discarded").when(text.contains(quote), "exact").otherwise("collapsed")
    return joined.withColumns({"status": status, "reason": reason}).drop("chunk_text", "known")


def _windows(parts: Column, size: int, kind: str) -> Column:
    """A hash of each run of `size` neighbours in an array: the array beside itself, shifted by 1, 2, ... places."""
    if size == 1:
        return F.transform(parts, lambda p: F.xxhash64(F.lit(kind), p))
    shifted = [F.slice(parts, 1 + i, F.greatest(F.size(parts) - (size - 1), F.lit(0))).alias(f"p{i}") for i in range(size)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(F.lit(kind), *(z[f"p{i}"] for i in range(size))))


def occurrences(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, chunk_id) of chunks that hold a quote's text, white space collapsed.

    A quote's inner words, at most four from the second, are its anchor; chunks are cut into windows of as many words,
    and only equal windows are compared in full. A quote of one or two words has no inner word; its first 1, 2, 4 or 8
    characters are its anchor among the chunks' windows of characters. Chunks are cut only into sizes that occur.
    """
    words, length = F.size(F.split("quote", " ")), F.length("quote")
    size = F.when(words > 2, F.least(F.lit(ANCHOR), words - 2)).otherwise(-F.when(length >= 8, 8).when(length >= 4, 4).otherwise(F.least(length, F.lit(2))))
    every = [*range(1, ANCHOR + 1), -1, -2, -4, -8]  # of words, then of characters

    def pick(make) -> Column:
        out = F.when(F.col("size") == every[0], make(every[0]))
        for s in every[1:]:
            out = out.when(F.col("size") == s, make(s))
        return out

    def own(s: int) -> Column:
        return _windows(F.slice(F.split("quote", " "), 2, s) if s > 0 else F.slice(F.split("quote", ""), 1, -s), abs(s), str(s))[0]

    q = quotes.select("quote_id", collapsed(F.col("quote")).alias("quote")).where("quote != ''").withColumn("size", size).withColumn("anchor", pick(own))
    sizes = sorted(r[0] for r in q.select("size").distinct().collect())  # eight rows at most
    anchors = q.select("anchor").distinct()
    few = anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    c = chunks.where("text is not null").select("chunk_id", collapsed(F.col("text")).alias("text"))
    cut = c.withColumn("words", F.split("text", " ")) if any(s > 0 for s in sizes) else c
    cut = cut.withColumn("letters", F.split("text", "")) if any(s < 0 for s in sizes) else cut
    found = [_windows(F.col("words" if s > 0 else "letters"), abs(s), str(s)) for s in sizes]
    near = cut.select("chunk_id", F.explode(F.array_distinct(F.concat(*found) if found else F.expr("cast(array() as array<bigint>)"))).alias("anchor"))
    near = near.join(F.broadcast(anchors) if few else anchors, "anchor", "left_semi")
    pairs = near.join(q.select("anchor", "quote_id", "quote"), "anchor").select("chunk_id", "quote_id", "quote").distinct()
    return pairs.join(c, "chunk_id").where(F.col("text").contains(F.col("quote"))).select("quote_id", "chunk_id")


def only_home(found: DataFrame) -> DataFrame:
    """Of occurrences, the quotes that one chunk alone holds."""
    return found.groupBy("quote_id").agg(F.count_distinct("chunk_id").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").drop("n")


def named(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """`texts` joined to the names that they mention as whole tokens: an equi-join on the name's token that fewest names have, then the full test."""

    def tokens(of: Column) -> Column:
        return F.explode(F.array_distinct(F.filter(F.split(F.lower(of), "[^a-z0-9]+"), lambda t: t != "")))

    own = names.select("name", tokens(F.col("name")).alias("token")).distinct()
    rarest = own.join(own.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("name").agg(F.min_by("token", F.struct("n", -F.length("token"), "token")).alias("token"))
    pairs = texts.withColumn("token", tokens(F.col(text))).join(names.join(rarest, "name"), "token").drop("token")
    return pairs.where(mentions(F.col(text), F.col("name")))
