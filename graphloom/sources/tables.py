"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where none is set, local mode gets a folder of this machine; on a cluster
    that is an error, as executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one computation, which can go as soon as the next is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, written to the shared folder and read back, so that nothing is computed twice."""
        path = f"{shared_folder(self.spark)}/graphloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names that are there."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in (p for n in names for p in self.paths.pop(n, [])):
            at = hadoop.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_oldest(self, name: str) -> None:
        """Deletes all tables of this name but the latest."""
        *old, last = self.paths[name]
        self.paths[name] = old
        self.drop(name)
        self.paths[name] = [last]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table that stays."""
    return Scratch(df.sparkSession).written(df, name)
