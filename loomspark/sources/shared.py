"""The folder that the driver and all executors share, and tables that a job keeps there while it needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else its checkpoint folder; a new local one where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomspark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(qualified)
    return qualified


def new(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def move(spark: SparkSession, path: str, to: str, prefix: str) -> None:
    """Moves a folder's files into the folder to, their names after a prefix that tells this folder's from others'."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    where = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in where.listStatus(new(path)):
        if found.isFile() and not found.getPath().getName().startswith(("_", ".")) and not where.rename(found.getPath(), new(to, prefix + found.getPath().getName())):
            raise OSError(f"{found.getPath().toString()} can't be moved")


class Kept:
    """Tables written to a folder of their own, which goes when the block ends; what leaves the block is settled() before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, new(spark, "kept"), 0

    def __enter__(self) -> Kept:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def settled(self, df: DataFrame) -> DataFrame:
        """The same rows from a reliable checkpoint, of which Spark is the owner."""
        return df.checkpoint(eager=True)

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.path)
