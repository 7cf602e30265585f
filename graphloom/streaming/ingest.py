"""Continuous ingestion: new JSON-lines files become points of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embedding import Embedder
from ..sources.jsonl import read_jsonl
from ..sources.points import to_points, upsert


#: Files of one batch, whose names reach the driver.
MOST_FILES = 1000


def stream_points(spark: SparkSession, folder: str, graph: str, path: str, embedder: Embedder, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts every new file's records; ids are stable, so a batch that runs twice changes nothing.

    A batch's files are read as by ``read_jsonl``: other keys are kept, and a bad
    line raises an error that names it.
    """

    def write(batch: DataFrame, _: int) -> None:
        files = sorted(r.file for r in batch.select("file").distinct().collect())  # MOST_FILES at most
        if files:
            upsert(to_points(read_jsonl(spark, files), graph, embedder), path)

    lines = spark.readStream.option("maxFilesPerTrigger", MOST_FILES).text(folder).select(F.input_file_name().alias("file"))
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
