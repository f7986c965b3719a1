"""View models of the reports: tallies, totals, tables and the correspondence of generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import markdown_cell

# Exit codes of a run (nothing to model, tools missing, a gate failed).
EXIT_OK, EXIT_FAILED, EXIT_INPUT, EXIT_TOOLS = 0, 1, 2, 3


def tally(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by, status).agg(F.count("*").alias("n"))


def traceability(rows: DataFrame) -> DataFrame:
    """rows(kind, traces, assumptions): elements, traced, assumption_only and inheriting (neither) by kind."""
    traced, assumed = F.coalesce(F.col("traces"), F.lit(0)) > 0, F.coalesce(F.col("assumptions"), F.lit(0)) > 0
    return rows.groupBy("kind").agg(F.count("*").alias("elements"), F.count_if(traced).alias("traced"), F.count_if(~traced & assumed).alias("assumption_only"), F.count_if(~traced & ~assumed).alias("inheriting"))


def top_with_more(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, and how many more it has (a report's capped list)."""
    counts = rows.groupBy(by).agg(F.count("*").alias("c"))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)
    return top.join(counts, by).withColumn("more", F.greatest(F.col("c") - k, F.lit(0))).drop("c")


def usage(calls: DataFrame, by: str, input_price: float = 2.5, output_price: float = 10.0) -> DataFrame:
    """calls(by, input_tokens, output_tokens, cached) in sum, with the cost at prices a million tokens; cached calls cost nothing."""
    cost = F.when(~F.col("cached"), (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6).otherwise(0.0)
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if("cached").alias("cached"), F.round(F.sum(cost), 6).alias("cost_usd"),
    )


def exit_code(stages: DataFrame) -> DataFrame:
    """stages(run, stage, code): an input problem of the first stages, then tools, any input problem, a failed gate, else 0."""
    early = F.bool_or(F.col("stage").isin("ingest", "extract") & (F.col("code") == EXIT_INPUT))

    def has(code: int) -> Column:
        return F.coalesce(F.bool_or(F.col("code") == code), F.lit(False))

    return stages.groupBy("run").agg(F.when(F.coalesce(early, F.lit(False)), EXIT_INPUT).when(has(EXIT_TOOLS), EXIT_TOOLS).when(has(EXIT_INPUT), EXIT_INPUT).when(has(EXIT_FAILED), EXIT_FAILED).otherwise(EXIT_OK).alias("exit_code"))


def split_requirements(requirements: DataFrame, elements: DataFrame) -> DataFrame:
    """Active requirements(id, status, satisfied_by array): satisfied by a known element, or not modelled."""
    active = requirements.where("status <> 'superseded'").select("id", F.explode_outer("satisfied_by").alias("element"))
    hit = active.join(elements.select(F.col("id").alias("element"), F.lit(True).alias("known")), "element", "left")
    return hit.groupBy("id").agg(F.count("known").alias("satisfied_by")).withColumn("outcome", F.when(F.col("satisfied_by") > 0, "satisfied").otherwise("not modelled"))


def agreed_types(uses: DataFrame) -> DataFrame:
    """uses(kind, name, type): the type that all uses share, else null."""
    return uses.groupBy("kind", "name").agg(F.when(F.count_distinct("type") == 1, F.min("type")).alias("type"), F.count("*").alias("uses"))


def correspondence(elements: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """elements(id) beside the ids that two generated texts hold: both, first only, second only or missing."""
    a, b = (d.select("id", F.lit(True).alias(n)).distinct() for d, n in ((first, "in_first"), (second, "in_second")))
    status = F.when(F.col("in_first") & F.col("in_second"), "both").when(F.col("in_first"), "first only").when(F.col("in_second"), "second only").otherwise("missing")
    return elements.join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce(status, F.lit("missing")).alias("status"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(c).cast("string")) for c in columns)), F.lit(" |")).alias("line"))


def conflict_lines(candidates: DataFrame) -> DataFrame:
    """candidates(key, value, source, rank): one line per key with its values' sources in order of authority."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda x: x["source"]), ", ")
    return candidates.groupBy("key", "value").agg(F.min("rank").alias("rank"), listed.alias("sources"))


def message_blocks(lines: DataFrame, start: str) -> DataFrame:
    """lines(source, n, line) of a tool's output: a line that matches `start` opens a message, others continue it."""
    opened = F.sum(F.when(F.col("line").rlike(start), 1).otherwise(0)).over(Window.partitionBy("source").orderBy("n"))
    found = lines.withColumn("message", opened).where("message > 0").groupBy("source", "message")
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
