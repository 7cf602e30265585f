"""Intermediate tables in the folder that all executors share, and bounded batches for Python."""

from pyspark.sql import SparkSession

from ..sources.tables import Scratch, shared_folder, written

__all__ = ["Scratch", "bounded_batches", "shared_folder", "written"]

#: Bytes of a batch of rows sent to Python, where the session does not say otherwise.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, which sends smaller batches than Spark's default: texts are long, and each task holds a batch twice."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return spark
