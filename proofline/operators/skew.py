"""Joins whose key may hold a large share of all rows, and numbering of all rows without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.storage import materialise

LEAST, MOST = 1000, 50_000  # a hot key has so many rows at least; there are so many hot keys at most
DEALT_ROWS = 1_000_000  # a task gets about so many of the rows that `dealt` deals


def dealt(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """`rows` (about n) dealt by the hash of keys, in as many partitions as n asks for, so that a task's share does not grow with n.

    What groups by the keys, or by more columns, runs on a partition as it stands, without a further shuffle. Few rows are
    dealt by the setting, and Spark may join their partitions.
    """
    spark, parts = rows.sparkSession, -(-n // DEALT_ROWS)
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys) if parts > usual else rows.repartition(*keys)


def hot_keys(rows: DataFrame, key: str, least: int | None = None) -> DataFrame | None:
    """Keys with at least `least` (LEAST) rows, and at least 1 / MOST of all, so MOST of them at most; None if there are none. rows is read twice."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = rows.count()
    heavy = materialise(counts.where(F.col("__n") >= max(least or LEAST, -(-total // MOST))).drop("__n"), "hot-keys")
    return None if heavy.isEmpty() else heavy


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str, heavy: DataFrame | None) -> DataFrame:
    """`rows` joined (inner or left) with a table that has at most one row a key; the table's rows of hot keys are broadcast."""
    if heavy is None:
        return rows.join(table, key, how)
    small = F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    usual = rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, how)
    return rows.join(F.broadcast(heavy), key, "left_semi").join(small, key, how).unionByName(usual)


def join_one(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` joined (inner or left) with a table that has at most one row a key, so that no task gets all rows of one key.

    rows is read twice: it should be a written table. Rows of a null key join with nothing.
    """
    return join_hot(rows, table, key, how, hot_keys(rows, key))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` dealt by a key that tells them apart, before costly work on each: a small file with many rows is read by few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sorted_ranges(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """`rows` written in sorted ranges of (keys, order), with `__p`, the range's number. A key of any size spans several ranges."""
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    return materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()), "ranges")


def before_ranges(ranges: DataFrame, keys: list[str], part: Column, total) -> DataFrame:
    """(keys, __p, __before): `total` over `part` of the same key's earlier ranges, for keys that span ranges.

    A range is shared with its neighbours by two keys at most, so this has at most two rows a range and may be broadcast.
    """
    each = ranges.groupBy(*keys, "__p").agg(part.alias("__part"))
    if keys:  # a key with one range has nothing before it, and these are most keys
        ends = ranges.groupBy("__p").agg(F.min(F.struct(*keys)).alias("__a"), F.max(F.struct(*keys)).alias("__b"))
        edge = ends.select("__p", F.explode(F.array_distinct(F.array("__a", "__b"))).alias("__k")).select("__p", *(F.col(f"__k.{k}").alias(k) for k in keys))
        each = joined_same(each, F.broadcast(edge), [*keys, "__p"], "left_semi")
    w = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, "__p", total(F.col("__part")).over(w).alias("__before")).where("__before is not null")


def joined_same(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join on columns of which null equals null, without the other side's copies of them."""
    other = b.select(*(F.col(c).alias(f"__r_{c}") for c in columns), *(c for c in b.columns if c not in columns))
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns]
    return a.join(other, on, how).drop(*(f"__r_{c}" for c in columns))


def numbered(rows: DataFrame, order, name: str = "number", keys: list[str] | None = None) -> DataFrame:
    """`rows` numbered from 1, within `keys` if given, in an order that tells all rows apart; no task gets all rows of a key.

    order: a column, or a list of columns and sort orders.
    """
    keys, order = keys or [], order if isinstance(order, list) else [order]
    ranges = sorted_ranges(rows, keys, order)
    own = F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*(F.col(o) if isinstance(o, str) else o for o in order)))
    before = before_ranges(ranges, keys, F.count("*"), F.sum)
    joined = joined_same(ranges.withColumn("__i", own), F.broadcast(before), [*keys, "__p"], "left")
    return joined.withColumn(name, F.col("__i") + F.coalesce("__before", F.lit(0))).drop("__p", "__i", "__before")


def carried(rows: DataFrame, value: str, order: list, name: str, keys: list[str]) -> DataFrame:
    """`rows` with the last value that is not null, at the row or before it in the order within `keys`."""
    ranges = sorted_ranges(rows, keys, order)
    w = Window.partitionBy("__p", *keys).orderBy(*(F.col(o) if isinstance(o, str) else o for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*(F.col(o) for o in order))))
    before = before_ranges(ranges, keys, last, lambda c: F.last(c, True))
    joined = joined_same(ranges.withColumn("__own", F.last(value, True).over(w)), F.broadcast(before), [*keys, "__p"], "left")
    return joined.withColumn(name, F.coalesce("__own", "__before")).drop("__p", "__own", "__before")


def running(rows: DataFrame, value: str, order: list, name: str, keys: list[str]) -> DataFrame:
    """`rows` with the sum of a value over the row and those before it in the order within `keys`."""
    ranges = sorted_ranges(rows, keys, order)
    w = Window.partitionBy("__p", *keys).orderBy(*(F.col(o) if isinstance(o, str) else o for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    before = before_ranges(ranges, keys, F.sum(value), F.sum)
    joined = joined_same(ranges.withColumn("__own", F.coalesce(F.sum(value).over(w), F.lit(0))), F.broadcast(before), [*keys, "__p"], "left")
    return joined.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__p", "__own", "__before")
