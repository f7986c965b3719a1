"""Graphs of parts, ports and links: components, drivers, pairings, topology."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators.skew import dealt, hot_keys, join_one, numbered
from proofline.storage import materialise, new_path


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links(a, b)`; root is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, and is written
    to the shared folder. Rounds grow with the logarithm of the longest path. labels has one row a node, so adaptive execution
    splits the links of a node that very many have; broadcasting its label instead costs several stages more each round.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).union(links.select("a", "b").where("a = b")).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        labels = materialise(stepped.join(up, "mid").select("node", "old", F.least("mid", "up").alias("root")), "labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def components_with_veto(links: DataFrame, formal: str) -> DataFrame:
    """(node, root) where two components that hold different formal tags (nodes that match the pattern `formal`) never join.

    The outcome is that of a union along `links(a, b, ord)` in the order of ord (then of a and b), which skips a link whose
    ends both hold a tag by then; links without an ord come last; root is the smallest node. It is found in rounds: a component without a tag surely joins
    along its first link, for no earlier link touches it and a tag on one side only never forbids. Links between components
    that both hold a tag go, as tags are never lost. Each round at least halves the components without a tag that have a link.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    owner = materialise(nodes.select("node", F.col("node").alias("comp")), "components")
    tagged = {x: F.coalesce(F.col(x).rlike(formal), F.lit(False)) for x in ("a", "b")}
    open_ = links.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), tagged["a"].alias("tx"), tagged["b"].alias("ty"), F.struct(F.col("ord").isNull().alias("late"), "ord", "a", "b").alias("at"))
    while True:
        ends = F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        tags = F.struct(F.when(F.col("x") < F.col("y"), F.col("tx")).otherwise(F.col("ty")).alias("tx"), F.when(F.col("x") < F.col("y"), F.col("ty")).otherwise(F.col("tx")).alias("ty"))
        open_ = open_.where("x <> y and not (tx and ty)").groupBy(ends.alias("e")).agg(F.first(tags).alias("t"), F.min("at").alias("at")).select("e.x", "e.y", "t.tx", "t.ty", "at")
        open_ = materialise(open_, "open-links")
        if open_.isEmpty():
            break
        sides = open_.select(F.col("x").alias("c"), F.col("tx").alias("t"), F.col("y").alias("other"), "at").union(open_.select("y", "ty", "x", "at"))
        first = materialise(sides.groupBy("c").agg(F.first("t").alias("t"), F.min(F.struct("at", "other")).alias("f")).select("c", "t", F.col("f.other").alias("other"), F.col("f.at").alias("at")), "first-links")
        theirs = first.select(F.col("c").alias("other"), F.col("other").alias("back"), F.col("t").alias("other_t"), F.col("at").alias("back_at"))
        top = F.col("t") | ((F.col("back") == F.col("c")) & (F.col("back_at") == F.col("at")) & ~F.col("other_t") & (F.col("c") < F.col("other")))
        up = materialise(first.join(theirs, "other").select("c", F.when(top, F.col("c")).otherwise(F.col("other")).alias("up"), "t"), "pointers")
        up = pointed(up)
        owner = materialise(owner.join(up.select(F.col("c").alias("comp"), F.col("up").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "components")
        for end, tag in (("x", "tx"), ("y", "ty")):
            to = up.select(F.col("c").alias(end), F.col("up").alias("__to"), F.col("top_t").alias("__t"))
            open_ = open_.join(to, end).withColumns({end: F.col("__to"), tag: F.col("__t")}).drop("__to", "__t")
    roots = owner.groupBy("comp").agg(F.min("node").alias("root"))
    return join_one(owner, roots, "comp").select("node", "root")


def pointed(up: DataFrame) -> DataFrame:
    """Pointers (c, up, t) followed to their tops by doubling: c, up, top_t (the top's t). A top points to itself."""
    while True:
        over = up.select(F.col("c").alias("up"), F.col("up").alias("over"), F.col("t").alias("top_t"))
        new = materialise(up.join(over, "up").select("c", F.col("up").alias("old"), F.col("over").alias("up"), "t", "top_t"), "pointers")
        if new.where("old <> up").isEmpty():
            return new.select("c", "up", "top_t")
        up = new.select("c", "up", "t")


HOT_INPUT = 100_000  # links of an input that has so many are not all brought to one task


def single_drivers(links: DataFrame) -> DataFrame:
    """Of `links(input, driver, rank, source)`: input, driver and n_drivers; driver is null where the best evidence ties.

    A driver's evidence is its best rank, then its number of distinct sources. Links are dealt by input once and counted there,
    a bounded number a task; those without an input, or of one that would fill a task, are counted step by step. links is read often.
    """
    heavy, usual, hot = hot_keys(links, "input", HOT_INPUT), links.where("input is not null"), links.where("input is null")
    if heavy is not None:
        hot = hot.unionByName(usual.join(F.broadcast(heavy), "input", "left_semi").select(links.columns))
        usual = usual.join(F.broadcast(heavy), "input", "left_anti")
    return _best_drivers(dealt(usual, ["input"], links.count())).unionByName(_best_drivers(hot))


def _best_drivers(links: DataFrame) -> DataFrame:
    evidence = links.groupBy("input", "driver").agg(F.min("rank").alias("rank"), (-F.count_distinct("source")).alias("sources"))
    level = evidence.groupBy("input", "rank", "sources").agg(F.count("*").alias("n"), F.min("driver").alias("driver"))
    best = level.groupBy("input").agg(F.min_by(F.struct("n", "driver"), F.struct("rank", "sources")).alias("b"), F.sum("n").alias("n_drivers"))
    return best.select("input", F.when(F.col("b.n") == 1, F.col("b.driver")).alias("driver"), "n_drivers")


def elect_kind(rows: DataFrame) -> DataFrame:
    """Of `rows(entity, kind, rank)`: the kind of the best rank, then the most frequent, then the first name; tied: kinds that shared the best rank."""
    each = rows.groupBy("entity", "kind").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    level = each.groupBy("entity", "rank").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("first"), F.count("*").alias("tied"))
    return level.groupBy("entity").agg(F.min_by(F.struct("first.kind", "tied"), "rank").alias("b")).select("entity", "b.kind", "b.tied")


def topology(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of parts by kind and of links by kinds of their ends (`?` where an end is unknown): what, n."""
    kinds = parts.select("id", "kind")
    a = kinds.select(F.col("id").alias("a"), F.col("kind").alias("ka"))
    b = kinds.select(F.col("id").alias("b"), F.col("kind").alias("kb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.concat(F.coalesce("ka", F.lit("?")), F.lit("->"), F.coalesce("kb", F.lit("?"))).alias("what"))
    return parts.select(F.concat(F.lit("part "), "kind").alias("what")).union(ends).groupBy("what").agg(F.count("*").alias("n"))


def repeatability(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ between two runs: key, n_first, n_second."""
    a, b = first.groupBy(key).agg(F.count("*").alias("n_first")), second.groupBy(key).agg(F.count("*").alias("n_second"))
    both = a.join(b, key, "full").select(key, F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_second", F.lit(0)).alias("n_second"))
    return both.where("n_first <> n_second")


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one bag has more often than the other, with change `removed` or `added`."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).union(after.exceptAll(before).withColumn("change", F.lit("added")))


def unconnected(ports: DataFrame, links: DataFrame, port: str = "port") -> DataFrame:
    """Ports that no link reaches."""
    return ports.join(links.select(port), port, "left_anti")


def only_pair(left: DataFrame, right: DataFrame, domain: str, keys: tuple[str, str]) -> DataFrame:
    """Pairs of ports with equal domain where exactly one pair exists; both sides are counted before they are joined."""
    a = left.groupBy(domain).agg(F.count("*").alias("n_left"), F.min(keys[0]).alias(keys[0]))
    b = right.groupBy(domain).agg(F.count("*").alias("n_right"), F.min(keys[1]).alias(keys[1]))
    return a.join(b, domain).select(domain, (F.col("n_left") * F.col("n_right")).alias("pairs"), F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), F.col(keys[0])).alias(keys[0]), F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), F.col(keys[1])).alias(keys[1]))


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The one value of a key, else null: key, n, value. What is not unique becomes a question and is never guessed."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v")).select(key, "n", F.when(F.col("n") == 1, F.col("v")).alias(value))


def similar_names(names: DataFrame) -> DataFrame:
    """Of `names(entity, kind, key)`: pairs of entities of one kind whose names share a letter and a number and no third does."""
    sig = F.concat(F.regexp_extract("key", "^([a-z])[a-z]*([0-9]+)$", 1), F.regexp_extract("key", "^([a-z])[a-z]*([0-9]+)$", 2))
    held = names.withColumn("signature", sig).where("signature <> ''").select("kind", "signature", "entity").distinct()
    both = held.groupBy("kind", "signature").agg(F.count("*").alias("n"), F.min("entity").alias("a"), F.max("entity").alias("b"))
    return both.where("n = 2").drop("n")


WALKED_ROWS = 10_000


def before_loops(links: DataFrame) -> DataFrame:
    """Of distinct links(a, b), those from which a loop can be reached: links into nodes without links out are peeled until none is left."""
    left, n = links, links.count()
    while n:
        left = materialise(left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "links")
        if (now := left.count()) == n:
            break
        n = now
    return left


def without_loops(links: DataFrame) -> DataFrame:
    """links(a, b) without those that close a loop in a walk in depth from the nodes that nothing feeds, in the order of names.

    The walk depends on the order. What lies behind the last loop cannot change it, so only the loops and the nodes that
    lead to them are walked, each connected block of these in one task; every other link is kept as it is.
    """
    plain = materialise(links.select("a", "b").distinct(), "links")
    looped = before_loops(plain)
    if looped.isEmpty():
        return plain
    blocks = components(looped).select("node", "root")
    types = dict(plain.dtypes)
    dealt = looped.join(blocks, looped.a == blocks.node).select("root", "a", "b").repartition("root").sortWithinPartitions("root", "a", "b")
    walked = dealt.mapInPandas(_walked_blocks, f"a {types['a']}, b {types['b']}")
    return plain.join(looped, ["a", "b"], "left_anti").unionByName(walked)


def _walked_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links that stay of blocks (root, a, b), which come one after the other, sorted, and may span batches."""
    root, block, kept = None, [], []
    for batch in batches:
        for r, a, b in zip(*(batch[c].tolist() for c in ("root", "a", "b")), strict=True):
            if r != root and block:
                _walk(block, kept)
                block = []
            root = r
            block.append((a, b))
        if len(kept) >= WALKED_ROWS:
            yield pd.DataFrame(kept, columns=["a", "b"], dtype=object)
            kept = []
    _walk(block, kept)
    yield pd.DataFrame(kept, columns=["a", "b"], dtype=object)


def _walk(links: list[tuple], kept: list[tuple]) -> None:
    """Adds to kept the links of one block, sorted, that a walk in depth finds not to lead back into its own way."""
    after: dict = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
    fed = {b for _, b in links}
    done: dict = {}  # False while a node is on the way, True after it
    for start in [*(n for n in after if n not in fed), *sorted(fed)]:
        if start in done:
            continue
        done[start] = False
        way = [(start, iter(after.get(start, ())))]
        while way:
            node, rest = way[-1]
            nxt = next(rest, None)
            if nxt is None:
                done[node] = True
                way.pop()
            elif done.get(nxt) is not False:
                kept.append((node, nxt))
                if nxt not in done:
                    done[nxt] = False
                    way.append((nxt, iter(after.get(nxt, ()))))


def columns(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, column): the longest path from a node without predecessors; links that close a loop are left out first."""
    return longest_paths(materialise(without_loops(links), "acyclic"), nodes)


def longest_paths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, column) along links(a, b) without loops."""
    now = nodes.select("node", F.lit(0).alias("column"))
    while True:
        pushed = links.join(now, links.a == now.node).groupBy("b").agg((F.max("column") + 1).alias("next"))
        new = materialise(now.join(pushed, now.node == pushed.b, "left").select("node", F.greatest("column", F.coalesce("next", F.lit(0))).alias("column"), F.col("column").alias("old")), "columns")
        now = new.select("node", "column")
        if new.where("column <> old").isEmpty():
            return now


COLUMN_STEP, ROW_STEP = 50, 40  # fixed values: the diagram's distances between columns and rows


def layout(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, column, row, x, y) of each of `nodes(node)`.

    Columns are longest paths over the links without loops. Rows are placed column after column: by the mean row of a node's
    predecessors, then by name; x and y are the node's origin, its column centred on 0. A round a column; each numbers its
    nodes in sorted ranges, so a column may hold most of the nodes.
    """
    spark = links.sparkSession
    kept = materialise(without_loops(links.where("a <> b")), "acyclic")
    placed = materialise(longest_paths(kept, nodes), "columns")
    sizes = {r.column: r.n for r in placed.groupBy("column").agg(F.count("*").alias("n")).collect()}  # a row a column
    path, done = new_path(spark, "rows"), None
    for column in sorted(sizes):
        members = placed.where(F.col("column") == column)
        if done is None:
            ordered = members.withColumn("mean", F.lit(0.0))
        else:
            mean = done.select(F.col("node").alias("a"), "row").join(kept, "a").groupBy("b").agg(F.avg("row").alias("mean"))
            ordered = members.join(mean.withColumnRenamed("b", "node"), "node", "left")
        number = numbered(ordered, [F.asc_nulls_last("mean"), F.col("node")], "row")
        y = F.rint(((sizes[column] - 1) / 2 - (F.col("row") - 1)) * ROW_STEP).cast("long")
        number.select("node", "column", (F.col("row") - 1).alias("row"), (F.col("column") * COLUMN_STEP).alias("x"), y.alias("y")).write.mode("append").parquet(path)
        done = spark.read.parquet(path)
    return done if done is not None else placed.selectExpr("node", "column", "0L as row", "column as x", "0L as y")


def icon_positions(ports: DataFrame) -> DataFrame:
    """ports(part, port, direction, ord) with side (right for outputs, else left) and y, even along the side in their order."""
    side = F.when(F.col("direction") == "out", "right").otherwise("left")
    w = Window.partitionBy("part", "side")
    placed = ports.withColumn("side", side).withColumn("n", F.row_number().over(w.orderBy("ord"))).withColumn("of", F.count("*").over(w))
    return placed.withColumn("y", icon_place(F.col("n"), F.col("of"))).drop("n", "of")


def icon_place(n: Column, of: Column, size: int = 100) -> Column:
    """Even places along a side from size to -size, in whole steps."""
    return F.rint(size - 2 * size * (n - 0.5) / of)
