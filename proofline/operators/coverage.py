"""How much of a reference a result covers: by id, then by shared names, each result used once."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.numbers import agree
from proofline.operators.graph import components
from proofline.operators.skew import numbered
from proofline.storage import materialise


def by_id(reference: DataFrame, produced: DataFrame) -> DataFrame:
    """category, reference, matched, missing, extra, percent of two tables (category, id); an empty reference counts as covered."""
    a = reference.select("category", "id").distinct().withColumn("in_reference", F.lit(1))
    b = produced.select("category", "id").distinct().withColumn("in_result", F.lit(1))
    both = a.join(b, ["category", "id"], "full")
    n, m = F.count("in_reference"), F.count_if(F.col("in_reference").isNotNull() & F.col("in_result").isNotNull())
    out = both.groupBy("category").agg(n.alias("reference"), m.alias("matched"), F.count_if(F.col("in_result").isNull()).alias("missing"), F.count_if(F.col("in_reference").isNull()).alias("extra"))
    return out.withColumn("percent", F.when(F.col("reference") == 0, 100.0).otherwise(F.round(100.0 * F.col("matched").cast("double") / F.col("reference"), 2)).cast("double"))


BLOCK_ROWS = 50_000  # blocks of so many rows are left to one task; larger ones are worked on in rounds


def greedy_pairs(reference: DataFrame, produced: DataFrame) -> DataFrame:
    """(category, reference, produced, by): by id first; what is left, in the order of ids, takes the first free result that shares a key.

    Both have category, id and keys (an array). What shares keys, directly or through others, is a block. Small blocks are
    walked in one task each. Large ones go through rounds (`greedy_rounds`) until they have fallen apart into small ones.
    """
    same = reference.join(produced.select("category", "id"), ["category", "id"]).select("category", F.col("id").alias("reference"), F.col("id").alias("produced"), F.lit("id").alias("by"))
    done = same.select("category", F.col("reference").alias("id"))
    sides = [d.join(done, ["category", "id"], "left_anti").select("category", "id", F.lit(s).alias("side"), F.explode(F.array_distinct("keys")).alias("key")) for d, s in ((reference, "r"), (produced, "p"))]
    rows, matched = materialise(sides[0].unionAll(sides[1]).where("key is not null").distinct(), "pair-keys"), same
    while True:
        named = rows.withColumn("node", F.to_json(F.struct("category", "side", "id"))).withColumn("hub", F.to_json(F.struct("category", "key")))
        blocks = components(named.select(F.col("node").alias("a"), F.col("hub").alias("b")))
        owned = materialise(named.join(blocks, "node").select("root", *rows.columns), "blocks")
        large = materialise(owned.groupBy("root").count().where(F.col("count") > BLOCK_ROWS).select("root"), "large")
        small = owned.join(large, "root", "left_anti")
        matched = matched.unionAll(small.groupBy("root").applyInPandas(_walk, "category string, reference string, produced string, by string"))
        if large.isEmpty():
            return matched
        rows, pairs = greedy_rounds(owned.join(large, "root", "left_semi").drop("root"))
        matched = matched.unionAll(pairs)


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The greedy choice inside one block: each key's results are met in order, and what is taken is passed over once."""
    takers: dict = defaultdict(list)
    offers: dict = defaultdict(list)
    for category, id_, side, key in sorted(rows[["category", "id", "side", "key"]].itertuples(index=False, name=None)):
        if side == "r":
            takers[category, id_].append(key)
        else:
            offers[category, key].append(id_)
    place: dict = defaultdict(int)
    taken, out = set(), []
    for (category, id_), keys in takers.items():
        firsts = []
        for at in ((category, key) for key in keys):
            free = offers.get(at, ())
            while place[at] < len(free) and (category, free[place[at]]) in taken:
                place[at] += 1
            firsts += free[place[at] : place[at] + 1]
        if firsts:
            taken.add((category, best := min(firsts)))
            out.append((category, id_, best, "alias"))
    return pd.DataFrame(out, columns=["category", "reference", "produced", "by"], dtype=object)


def greedy_rounds(rows: DataFrame, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """What is left of rows(category, id, side, key) after some rounds of sure pairs, and the pairs.

    Sure is a reference and a result each of which is the other's first. Where a key is the only one that its members have
    left, the n-th reference takes the n-th result, all at once. Keys that have the same members count as one key, so
    names that always come together do not hold each other up. Rows meet at keys only; pairs are never spelled out.
    """
    none = rows.limit(0).select("category", F.col("id").alias("reference"), F.col("id").alias("produced"), F.lit("alias").alias("by"))
    pairs = none
    for _ in range(rounds):
        member = F.struct("side", "id")
        marks = [F.sum(F.xxhash64(F.lit(i), member).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
        keys = rows.groupBy("category", "key").agg(F.count_if(F.col("side") == "r").alias("n_r"), F.count_if(F.col("side") == "p").alias("n_p"), *marks)
        one = keys.where("n_r > 0 and n_p > 0").groupBy("category", "n_r", "n_p", "h0", "h1").agg(F.min("key").alias("key")).select("category", "key")
        rows = materialise(rows.join(one, ["category", "key"], "left_semi").select("category", "id", "side", "key"), "pair-keys")
        if rows.isEmpty():
            break
        lone = rows.groupBy("category", "id", "side").agg(F.count("*").alias("n"))
        pure = rows.join(lone, ["category", "id", "side"]).groupBy("category", "key").agg(F.max("n").alias("most")).where("most = 1").select("category", "key")
        placed = numbered(rows.join(pure, ["category", "key"], "left_semi"), [F.col("id")], "place", keys=["category", "key", "side"])
        left, right = (placed.where(F.col("side") == s).select("category", "key", "place", F.col("id").alias(n)) for s, n in (("r", "reference"), ("p", "produced")))
        ranked = left.join(right, ["category", "key", "place"]).select("category", "reference", "produced")
        mixed = rows.join(pure, ["category", "key"], "left_anti")
        heads = mixed.groupBy("category", "key").agg(F.min(F.when(F.col("side") == "r", F.col("id"))).alias("r"), F.min(F.when(F.col("side") == "p", F.col("id"))).alias("p"))
        best = mixed.join(heads, ["category", "key"]).groupBy("category", "side", "id").agg(F.min(F.when(F.col("side") == "r", F.col("p")).otherwise(F.col("r"))).alias("first"))
        wants, gives = (best.where(F.col("side") == s) for s in ("r", "p"))
        sure = wants.select("category", F.col("id").alias("reference"), F.col("first").alias("produced")).join(gives.select("category", F.col("id").alias("produced"), F.col("first").alias("reference")), ["category", "reference", "produced"])
        found = materialise(ranked.unionByName(sure), "pairs")
        pairs = pairs.unionAll(found.withColumn("by", F.lit("alias")))
        gone = found.select("category", F.lit("r").alias("side"), F.col("reference").alias("id")).union(found.select("category", F.lit("p"), "produced"))
        over = pure.withColumn("over", F.lit(True))  # what a pure key has left has no partner
        rest = rows.join(gone, ["category", "side", "id"], "left_anti").join(over, ["category", "key"], "left").where("over is null")
        rows = materialise(rest.select("category", "id", "side", "key"), "pair-keys")
    return rows, pairs


def parameters(reference: DataFrame, produced: DataFrame) -> DataFrame:
    """reference and produced (owner, name, value): status matched, mismatched, missing or extra of each quantity."""
    a, b = (d.select("owner", "name", F.col("value").alias(n)) for d, n in ((reference, "want"), (produced, "got")))
    status = F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "missing").when(agree(F.col("want"), F.col("got")), "matched").otherwise("mismatched")
    return a.join(b, ["owner", "name"], "full").withColumn("status", status)
