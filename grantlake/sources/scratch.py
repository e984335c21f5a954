"""Written tables that cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode one of our own if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='grantlake-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def own_root(spark: SparkSession) -> str:
    """Where this application's written tables are, all of them."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the written tables of this application: for its end, when no frame is to be read any more."""
    delete(spark, own_root(spark))


class Rounds:
    """Tables of the rounds of fixpoints, in a folder of their own. Frames that read them need them, so they stay until drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{own_root(spark)}/rounds-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.base)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
