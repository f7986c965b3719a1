"""Ordered outputs in parts that are published at once, and a cache whose first writer of a key wins.

A table is sorted over ranges and written as parts, whose texts in the order of their names are the output: its bytes do
not depend on how many parts there are. A part folder counts once a manifest names it; the manifest is written aside and
renamed to its name, which fails where there is one (on stores whose rename replaces nothing), so of several writers one
wins and readers never see half an output.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, data: str) -> bool:
    """Write a small file unless there is one; whether this call did. Its content appears at once, by a rename."""
    at, files = _file(spark, path)
    new, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(new, False)
    out.write(bytearray(data.encode()))
    out.close()
    own = not files.exists(at) and files.rename(new, at)
    if not own:
        files.delete(new, False)
    return own


def read_small(spark: SparkSession, path: str) -> str | None:
    at, files = _file(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, path: str, order: list[str], line: str | None = None) -> bool:
    """Write a table as lines in a fixed order (of `order`, then of the whole row) and publish them: JSON of each row, or its
    column `line`. False, and nothing changes, if `path` is published already."""
    spark = df.sparkSession
    if read_small(spark, f"{path}/{MANIFEST}") is not None:
        return False
    text = F.col(line) if line else F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))
    rows = df.withColumn("__text", text).orderBy(*order, "__text").select(F.col("__text").alias("value"))
    parts = f"parts-{uuid.uuid4().hex}"
    rows.write.text(f"{path}/{parts}")
    return create(spark, f"{path}/{MANIFEST}", json.dumps({"parts": parts}))


def published(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a published output: part (its place) and value; their order within a part is the files' own."""
    held = read_small(spark, f"{path}/{MANIFEST}")
    if held is None:
        raise FileNotFoundError(f"{path} is not published")
    rows = spark.read.option("lineSep", "\n").text(f"{path}/{json.loads(held)['parts']}")
    return rows.select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), "value")


def put(entries: DataFrame, path: str, key: str, value: str) -> DataFrame:
    """Add entries(key, value) to a cache; of several values of a key the smallest of the first batch that has it stays. The entries that are new.

    A batch is a folder of its own, numbered as it is published, so that readers agree on which came first.
    """
    spark = entries.sparkSession
    known = cached(spark, path)
    own = entries.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(F.col(value).cast("string")).alias("value"))
    new = own if known is None else own.join(known, "key", "left_anti")
    parts = f"{path}/batch-{uuid.uuid4().hex}"
    new.write.parquet(parts)
    n = len(batches(spark, path))
    while not create(spark, f"{path}/{n:09}.json", json.dumps({"parts": parts.rpartition("/")[2]})):
        n += 1
    return spark.read.parquet(parts)


def batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of a cache's batches in the order in which they were published."""
    out: list[str] = []
    while (held := read_small(spark, f"{path}/{len(out):09}.json")) is not None:
        out.append(json.loads(held)["parts"])
    return out


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, value) of a cache, of each key the value of the first batch; None before anything was put."""
    found = batches(spark, path)
    if not found:
        return None
    each = [spark.read.schema("key string, value string").parquet(f"{path}/{p}").withColumn("__n", F.lit(n)) for n, p in enumerate(found)]
    every = each[0]
    for e in each[1:]:
        every = every.unionAll(e)
    return every.groupBy("key").agg(F.min_by("value", "__n").alias("value"))
