"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs in this process (tests), a folder of our own, gone at exit.

    On a cluster executors do not see such a folder, so there the setting is asked for.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_.get() if set_.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="proofline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, under the application's own name."""
    return f"{shared_dir(spark).rstrip('/')}/proofline/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; call it once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/proofline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: it cuts lineage and survives lost executors. codec: other than the session's."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, what)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one table of the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
