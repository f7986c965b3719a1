"""Chunks of sources: lines to capped blocks and paragraphs, keys, roles and greedy batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import line_range
from proofline.operators.skew import carried, joined_same, numbered, running
from proofline.storage import materialise

MAX_CHUNK, MAX_BATCH, MAX_QUOTE = 900, 4000, 300
WHOLE_LINES, WHOLE_CHARS = 10_000, 1_000_000  # a source of at most both is cut as one row; the lines of longer ones stay rows


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def block_starts(sizes: Column, breaks: Column, cap: int) -> Column:
    """0-based starts of greedy blocks: a block ends before an item that would take it past `cap`, or where breaks is true.

    A fold over one source's items; its state is the open block's size and the starts so far.
    """
    start = F.struct(F.lit(0).cast("long").alias("size"), F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).alias("i"))
    items = F.zip_with(sizes, breaks, lambda s, b: F.struct(s.alias("s"), b.alias("b")))

    def step(done: Column, item: Column) -> Column:
        new = (done["i"] == 0) | item["b"] | (done["size"] + item["s"] > cap)
        return F.struct(
            F.when(new, item["s"]).otherwise(done["size"] + item["s"]).cast("long").alias("size"), F.when(new, F.concat(done["starts"], F.array(done["i"]))).otherwise(done["starts"]).alias("starts"), (done["i"] + 1).alias("i")
        )

    return F.aggregate(items, start, step, lambda done: done["starts"])


def blocks(sources: DataFrame, key: str, text: str = "text", cap: int = MAX_CHUNK, starts_block: str | None = None) -> DataFrame:
    """Capped blocks of consecutive lines: key, block, first_line, last_line, locator, chunk. starts_block: a pattern of lines that open a block.

    Null texts have no blocks; blocks of blank lines are left out.
    """
    return _cut(sources.where(F.col(text).isNotNull()).select(key, lines(F.col(text)).alias("l")), key, cap, starts_block)


def _cut(own: DataFrame, key: str, cap: int, starts_block: str | None) -> DataFrame:
    """The blocks of sources given as (key, l), l the array of their lines."""
    breaks = F.transform("l", lambda x: F.regexp_like(x, F.lit(starts_block)) if starts_block else F.lit(False))
    cut = own.withColumn("s", block_starts(F.transform("l", lambda x: F.length(x) + 1), breaks, cap))
    each = cut.select(key, "l", "s", F.posexplode("s").alias("block", "a")).withColumn("b", F.coalesce(F.get("s", F.col("block") + 1), F.size("l")))
    chunk = F.regexp_replace(F.array_join(F.slice("l", F.col("a") + 1, F.col("b") - F.col("a")), "\n"), "^\n+|\n+$", "")
    out = each.select(key, "block", (F.col("a") + 1).alias("first_line"), F.col("b").alias("last_line"), chunk.alias("chunk"))
    return out.where(F.trim("chunk") != "").withColumn("locator", line_range(F.col("first_line"), F.col("last_line")))


def paragraphs(sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Runs of lines that are not blank: key, paragraph, first_line, last_line, chunk."""
    rows = sources.where(F.col(text).isNotNull()).select(key, F.posexplode(lines(F.col(text))).alias("n", "line"))
    blank = F.sum(F.when(F.trim(F.regexp_replace("line", r"\s", " ")) == "", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("n"))
    runs = rows.withColumn("run", blank).where(F.trim(F.regexp_replace("line", r"\s", " ")) != "").groupBy(key, "run")
    found = runs.agg((F.min("n") + 1).alias("first_line"), (F.max("n") + 1).alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("chunk"))
    return found.withColumn("paragraph", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).drop("run")


def headings(rows: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """`rows` with the heading in force carried down as `section`; a source of any size is carried over sorted ranges."""
    return carried(rows, heading, [order], "section", [key])


def chunk_keys(chunks: DataFrame, source: str, order: str) -> DataFrame:
    """`chunks` with pos (from 0) and chunk_id `source#pos`; a source of any size is numbered over sorted ranges."""
    return numbered(chunks, [order], "pos", [source]).withColumn("pos", (F.col("pos") - 1).cast("int")).withColumn("chunk_id", F.concat_ws("#", F.col(source).cast("string"), F.col("pos").cast("string")))


def ruled_blocks(lines: DataFrame, key: str, order: str, size: Column, opens: Column, cap: int = MAX_CHUNK) -> DataFrame:
    """`lines` with block (from 0) and its first line's place `start` (from 0) by the rule of block_starts, a row a line.

    For sources of any length: nothing holds a source whole. Each line's next start is found by search in the running sums,
    carried over sorted ranges; those that can be reached from a source's first line are found by doubling the steps. size
    is above 0; opens is true where a line opens a block.
    """
    rows = lines.withColumns({"__s": size.cast("long"), "__o": F.coalesce(opens, F.lit(False))})
    own = numbered(running(rows, "__s", [order], "__end", [key]), [order], "__n", [key]).withColumn("__n", F.col("__n") - 1)
    slim = materialise(own.select(key, "__n", "__s", "__o", "__end"), "line-sizes")
    # A block from line n holds what ends by its own beginning plus cap: the first line that ends later starts the next one.
    ends = slim.select(key, F.col("__end").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ask"), F.col("__n").alias("at"))
    asks = slim.select(key, (F.col("__end") - F.col("__s") + cap).alias("v"), F.lit(0).alias("kind"), F.col("__n").alias("ask"), F.lit(None).cast("long").alias("at"))
    down = ends.unionAll(asks).select(key, (-F.col("v")).alias("v"), "kind", "ask", "at")
    full = carried(down, "at", ["v", "kind"], "full", [key]).where("ask is not null").select(key, F.col("ask").alias("__n"), F.when(F.col("full").isNotNull(), F.greatest("full", F.col("ask") + 1)).alias("full"))
    marks = slim.select(key, (-F.col("__n")).alias("v"), F.when(F.col("__o"), F.col("__n")).alias("at"))
    marked = carried(marks, "at", ["v"], "here", [key]).select(key, (-F.col("v") - 1).alias("__n"), F.col("here").alias("broken"))
    step = materialise(full.join(marked, [key, "__n"], "left").select(key, F.col("__n").alias("n"), F.least("full", "broken").alias("to")).where("to is not null"), "next-starts")
    reached = materialise(slim.select(key).distinct().select(key, F.lit(0).cast("long").alias("n")), "starts")
    while not step.isEmpty():
        more = reached.join(step, [key, "n"]).select(key, F.col("to").alias("n"))
        reached = materialise(reached.union(more).distinct(), "starts")
        over = step.select(key, F.col("n").alias("to"), F.col("to").alias("__over"))
        step = materialise(step.join(over, [key, "to"]).select(key, "n", F.col("__over").alias("to")), "next-starts")
    first = own.join(reached.select(key, F.col("n").alias("__n"), F.lit(1).alias("__first")), [key, "__n"], "left").withColumn("__start", F.when(F.col("__first") == 1, F.col("__n")))
    counted = running(carried(first, "__start", ["__n"], "start", [key]), "__first", ["__n"], "block", [key])
    return counted.withColumn("block", F.col("block") - 1).select(*lines.columns, F.col("__n").alias("place"), "start", "block")


def blocks_of_lines(lines: DataFrame, key: str, order: str, line: str = "line", cap: int = MAX_CHUNK, starts_block: str | None = None) -> DataFrame:
    """What `blocks` gives, for sources whose lines are rows: key, block, first_line, last_line, locator, chunk.

    Sources are measured first: one that fits a row is gathered and cut there, a longer one by ruled_blocks. lines is read twice.
    """
    own = lines.select(key, order, F.coalesce(F.col(line), F.lit("")).alias("__line"))
    sizes = own.groupBy(key).agg(F.count("*").alias("__n"), F.sum(F.length("__line") + 1).alias("__c"))
    long = materialise(sizes.where((F.col("__n") > WHOLE_LINES) | (F.col("__c") > WHOLE_CHARS)).select(key), "long-sources")
    none = long.isEmpty()
    short = own if none else joined_same(own, long, [key], "left_anti")
    whole = short.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "__line"))).alias("l"))
    found = _cut(whole.select(key, F.transform("l", lambda x: x["__line"]).alias("l")), key, cap, starts_block)
    return found if none else found.unionByName(_blocks_of_long(joined_same(own, long, [key], "left_semi"), key, order, cap, starts_block))


def _blocks_of_long(own: DataFrame, key: str, order: str, cap: int, starts_block: str | None) -> DataFrame:
    """The blocks of sources given as rows (key, order, __line), of any length."""
    opens = F.regexp_like("__line", F.lit(starts_block)) if starts_block else F.lit(False)
    cut = ruled_blocks(own, key, order, F.length("__line") + 1, opens, cap)
    whole = cut.groupBy(key, "block").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.array_sort(F.collect_list(F.struct("place", "__line"))).alias("l"))
    chunk = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["__line"]), "\n"), "^\n+|\n+$", "")
    out = whole.select(key, F.col("block").cast("int").alias("block"), (F.col("a") + 1).cast("int").alias("first_line"), (F.col("b") + 1).cast("int").alias("last_line"), chunk.alias("chunk"))
    return out.where(F.trim("chunk") != "").withColumn("locator", line_range(F.col("first_line"), F.col("last_line")))


def batches(sources: DataFrame, key: str, chunks: str, cap: int = MAX_BATCH) -> DataFrame:
    """Greedy batches of a source's chunks (an array of texts): key, batch, first_chunk, n_chunks, n_chars."""
    own = sources.where(F.size(chunks) > 0).select(key, F.transform(chunks, lambda c: F.length(c)).alias("n"))
    cut = own.withColumn("s", block_starts(F.col("n"), F.transform("n", lambda _: F.lit(False)), cap))
    each = cut.select(key, "n", "s", F.posexplode("s").alias("batch", "first_chunk")).withColumn("n_chunks", F.coalesce(F.get("s", F.col("batch") + 1), F.size("n")) - F.col("first_chunk"))
    return each.select(key, "batch", "first_chunk", "n_chunks", F.aggregate(F.slice("n", F.col("first_chunk") + 1, F.col("n_chunks")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"))


def with_roles(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with the role of their own or of their source, without those of unread sources. chunks(source_id, role), sources(source_id, role, status)."""
    return chunks.join(sources.where("status <> 'unread'").select("source_id", F.col("role").alias("source_role")), "source_id").withColumn("role", F.coalesce("role", "source_role")).drop("source_role")


def newest_first(messages: DataFrame, thread: str, when: str, pos: str) -> DataFrame:
    """`messages` with rank in the thread: newest first, undated last, ties in their order; a thread of any size is numbered over sorted ranges."""
    return numbered(messages, [F.desc_nulls_last(when), F.col(pos)], "rank", [thread]).withColumn("rank", F.col("rank").cast("int"))


def source_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """`files` with source_id: the folded path, with a counter from the second on where paths fold alike."""
    folded = files.withColumn("base", F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    n = F.row_number().over(Window.partitionBy("base").orderBy(path))
    return folded.withColumn("source_id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string")))).drop("base")
