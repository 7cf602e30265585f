"""Points: records with vectors under stable ids, stored in Parquet by graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, embedded
from ..functions.text import point_id

SCHEMA = "id string, vector array<float>, iri array<string>, label string, repr string, iri_count long, extra map<string,string>, graph string"


def to_points(records: DataFrame, graph: str, embedder: Embedder) -> DataFrame:
    """Points of records; a record without text raises an error that names the graph.

    A record's own ``iri`` and ``repr`` win over ``iris`` and the text; the
    graph is always the one given.
    """
    message = f"{graph}: record is missing non-empty embedding_text"
    text = F.when(F.length("embedding_text") > 0, F.col("embedding_text")).otherwise(F.raise_error(F.lit(message)).cast("string"))
    first = F.when(F.size("iris") > 0, F.get("iris", F.lit(0))).otherwise(F.col("iri"))
    own = F.when(F.col("iri").isNotNull(), F.array("iri")).otherwise(F.col("iris"))
    rows = records.withColumn("text", text)
    return rows.select(
        point_id(F.lit(graph), first, F.col("text")).alias("id"), embedded(F.col("text"), embedder).alias("vector"), own.alias("iri"), "label",
        F.coalesce("repr", "text").alias("repr"), "iri_count", "extra", F.lit(graph).alias("graph"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def ensure_collection(spark: SparkSession, path: str, create: bool = False) -> None:
    """Error if there is no collection at a path, unless it may be created."""
    if _exists(spark, path):
        return
    if not create:
        raise ValueError(f"collection does not exist: {path}")
    spark.createDataFrame([], SCHEMA).write.partitionBy("graph").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All points; filters on the graph prune folders."""
    return spark.read.schema(SCHEMA).parquet(path)


def check_dimension(points: DataFrame, path: str) -> None:
    """Error if new vectors differ in size from each other or from those of a collection."""
    sizes = [r.d for r in points.select(F.size("vector").alias("d")).distinct().limit(2).collect()]
    there = [r.d for r in read_points(points.sparkSession, path).select(F.size("vector").alias("d")).limit(1).collect()]
    if len({*sizes, *there}) > 1:
        raise ValueError(f"vectors of dimension {sorted(sizes)} do not fit collection {path}" + (f" of dimension {there[0]}" if there else ""))


def upsert(points: DataFrame, path: str) -> int:
    """Insert or replace points by id within their graphs; other graphs' folders stay untouched.

    Points without a graph are a graph of their own.  Of several new points of
    one id, the one of the greatest content hash stays, whatever their order.
    The new state of the graphs concerned is written beside the table first, as
    a table cannot be read while it is overwritten, and then put in place of
    just those folders; who reads meanwhile may see some of them replaced.
    Returns the number of points given, counted as they are written.
    """
    spark = points.sparkSession
    ensure_collection(spark, path, create=True)
    check_dimension(points, path)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    given = Observation()
    fresh = points.observe(given, F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(1))
    graphs = points.select(F.col("graph").alias("concerned")).distinct()
    old = read_points(spark, path)
    old = old.join(graphs, old.graph.eqNullSafe(F.col("concerned")), "left_semi").select(*points.columns).withColumn("version", F.lit(0))
    content = F.xxhash64(F.to_json(F.struct(*points.columns)))
    last = F.row_number().over(Window.partitionBy("graph", "id").orderBy(F.desc("version"), F.desc(content)))
    merged = old.unionByName(fresh).withColumn("place", last).where(F.col("place") == 1).drop("place", "version")
    merged.write.partitionBy("graph").parquet(staged)
    rows = spark.read.schema(SCHEMA).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph").parquet(path)
    spark.catalog.refreshByPath(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(staged)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return given.get["n"]


def iri_index(points: DataFrame) -> DataFrame:
    """Columns iri and id: a side table for lookups by IRI."""
    return points.select(F.explode("iri").alias("iri"), "id", "graph")
