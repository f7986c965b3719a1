"""JSON texts as located records, split level by level in Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.evidence import MAX_CHUNK
from proofline.storage import materialise

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SEPARATED = rf'([^",:]*+(?:{STRING}[^",:]*+)*+[,:])'  # up to a sign that stands outside of strings


def spaced(compact: Column) -> Column:
    """Compact JSON with a space behind each comma and colon that stands outside of strings."""
    return F.regexp_replace(compact, SEPARATED, "$1 ")


def records(rows: DataFrame, key: str, text: str = "text", cap: int = MAX_CHUNK) -> DataFrame:
    """JSON texts of rows(key, text) as records: key, path, place, text, fields, reason.

    Each member of a top-level object is a record with its path; a value whose text passes `cap` characters is split into
    its members (`$.a.b`) or elements (`$.a[3]`), as deep as needed: a round a level, over written tables. A record of
    scalars has them as fields too. place orders a source's records (members by their names). What is not JSON gives one
    row with the reason; null texts give none.
    """
    parsed = F.call_function("try_parse_json", F.regexp_replace(text, "^﻿", ""))
    none = F.expr("cast(array() as array<int>)")
    read = rows.where(F.col(text).isNotNull()).select(key, parsed.alias("v"))
    unread = read.where("v is null").select(key, F.lit("$").alias("path"), none.alias("place"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit("not valid JSON").alias("reason"))
    front = read.where("v is not null").select(key, F.lit("$").alias("path"), none.alias("place"), spaced(F.to_json("v")).alias("text"), "v")
    done, top = [unread], True
    while True:
        front = materialise(front, "json-level")
        kind = F.substring(F.schema_of_variant("v"), 1, 5)
        splits = kind.isin("OBJEC", "ARRAY") & ~F.col("text").isin("{}", "[]") & (F.length("text") > cap)
        if top:
            splits = splits | ((kind == "OBJEC") & (F.col("text") != "{}"))
        kept = front.where(~splits)
        members = F.call_function("try_variant_get", "v", F.lit("$"), F.lit("map<string,variant>"))
        nested = F.exists(F.map_values(members), lambda x: F.substring(F.schema_of_variant(x), 1, 5).isin("OBJEC", "ARRAY"))
        scalars = F.map_filter(F.transform_values(members, lambda _, x: x.cast("string")), lambda _, x: x.isNotNull())
        done.append(kept.select(key, "path", "place", "text", F.when((kind == "OBJEC") & ~nested, scalars).alias("fields"), F.lit(None).cast("string").alias("reason")))
        large = front.where(splits).withColumnRenamed("path", "__path")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        kids = large.lateralJoin(front.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "member", "value"))
        path = F.when(F.col("member").isNotNull(), F.concat("__path", F.lit("."), "member")).otherwise(F.concat("__path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        front = kids.select(key, path.alias("path"), F.concat("place", F.array(F.col("pos").cast("int"))).alias("place"), spaced(F.to_json("value")).alias("text"), F.col("value").alias("v"))
        top = False
