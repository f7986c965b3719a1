"""Streams against the same rows as a batch."""

import pytest

from proofline.operators import series as batch
from proofline.streaming import series


@pytest.fixture
def files(spark, tmp_path):
    rows = [("a", float(i), i, float((i // 3) % 4)) for i in range(40)] + [("b", float(i), i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "series string, t double, ord long, value double")
    for n in range(4):
        df.where(f"t >= {n * 10} and t < {n * 10 + 10}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return df, str(tmp_path / "in"), str(tmp_path / "ck")


def test_changes(spark, files):
    df, path, checkpoint = files
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).select("series", "t", "value")
    q = series.changes(stream).writeStream.format("memory").queryName("seen_changes").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.series, r.t, r.value) for r in batch.changes(df, "value", 7.0).collect()}
    assert {tuple(r) for r in spark.sql("select series, t, value from seen_changes").collect()} == want


def test_profile(spark, files):
    df, path, checkpoint = files
    stream = spark.readStream.schema(df.schema).parquet(path).selectExpr("series", "timestamp_seconds(t * 60) as ts", "value")
    q = series.profile(stream).writeStream.outputMode("complete").format("memory").queryName("seen_profile").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(rows) from seen_profile").first()[0] == df.count()
