"""Records from JSON lines, with errors that name file and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE

RECORD = "iris array<string>, iri string, label string, embedding_text string, repr string, iri_count long"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns file, line (from 1) and value.

    Rows of a split come in order; the splits of a file are put in order by
    their counts, so no file is gathered in one task.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("before", before)
    return lines.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def _blank(value):
    return F.length(F.regexp_replace(value, WHITE, "")) == 0


def read_jsonl(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Columns file, line, those of RECORD, and extra with all other keys as JSON text.

    Blank lines are passed over, but count for the limit of lines per file.  A
    line that is no JSON object raises an error that names it.
    """
    lines = numbered_lines(spark, path)
    if limit is not None:
        lines = lines.where(F.col("line") <= limit)
    lines = lines.where(~_blank(F.col("value")))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    checked = (
        F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(where, F.lit(": invalid JSON"))))
        .when(~kind.startswith("OBJECT"), F.raise_error(F.concat(where, F.lit(": expected a JSON object"))))
        .otherwise(F.col("value"))
    )
    rows = lines.withColumn("value", checked.cast("string"))
    known = [f.split()[0] for f in RECORD.split(", ")]
    keys = F.array(*map(F.lit, known))
    return rows.select("file", "line", F.from_json("value", RECORD).alias("r"), F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~F.array_contains(keys, k)).alias("extra")).select("file", "line", "r.*", "extra")


def count_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> int:
    """Lines that are not blank, up to the limit."""
    n = spark.read.text(path).where(~_blank(F.col("value"))).count()
    return n if limit is None else min(n, limit)
