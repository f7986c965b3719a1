"""Profiles of tabular data: one row a column instead of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.numbers import finite

MAX_DISTINCT = 12


def numeric(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """column, min, max, first, last over one scan of the data; order ranks the rows."""
    ord_ = F.struct(*order)
    found = df.agg(*(F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.min_by(c, ord_).alias("first"), F.max_by(c, ord_).alias("last")).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("p")) for c in columns)))
    return found.select(pairs.alias("x")).select("x.column", "x.p.*")


def is_numeric(column: Column) -> Column:
    """Whether all non-empty cells are finite numbers (an aggregate)."""
    return F.coalesce(F.bool_and(F.when(F.trim(column) != "", finite(column).isNotNull())), F.lit(False))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str, most: int = MAX_DISTINCT) -> DataFrame:
    """Per key: n_distinct, shown (the first distinct values in the order in which they are first seen) and more.

    Values are reduced to one row each before they meet, so a key's list is never longer than `most`.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    counts = each.groupBy(*keys).agg(F.count("*").alias("n_distinct"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("n") <= most)
    shown = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value]), ", ").alias("shown"))
    return counts.join(shown, keys).withColumn("more", F.greatest(F.col("n_distinct") - most, F.lit(0)))


def time_span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("start"), F.max(column).alias("end"), F.count("*").alias("rows"))


def ragged(rows: DataFrame, key: str, cells: str) -> DataFrame:
    """Per key: rows, and those whose number of cells differs from the first row's. rows(key, n, cells array)."""
    size = F.size(cells)
    heads = rows.groupBy(key).agg(F.min_by(size, "n").alias("columns"))
    return rows.withColumn("cells", size).join(heads, key).groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("cells") != F.col("columns")).alias("ragged"))
