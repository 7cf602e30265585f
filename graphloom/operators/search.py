"""Similarity search over points: filters, exact and approximate top-k, surveys and facets.

Points have the columns id, vector, graph, iri (a list), label, repr and
iri_count; they are stored by graph, so a graph filter prunes partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent_encode
from ..functions.vectors import as_doubles, cosine


class NotFoundError(ValueError):
    """No point has the IRI asked for."""


@dataclass(frozen=True)
class Query:
    """What to search for, where, and which hits to return.

    text or node: the words, or the IRI of a point.  Either graphs to include or
    graphs to exclude may be given.
    """

    text: str | None = None
    node: str | None = None
    include_graphs: tuple[str, ...] = ()
    exclude_graphs: tuple[str, ...] = ()
    limit: int = 10
    offset: int = 0

    def __post_init__(self) -> None:
        if (self.text is None) == (self.node is None):
            raise ValueError("a query has either a text or a node")
        if self.include_graphs and self.exclude_graphs:
            raise ValueError("include_graphs and exclude_graphs cannot be used together")
        if self.limit < 1 or self.offset < 0:
            raise ValueError("limit is at least 1 and offset at least 0")


def build_query(feature_type: str, value: str, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | str = 10, offset: int | str = 0) -> Query:
    """A query from loose parts: numbers may be strings, empty lists are none."""
    if feature_type not in ("text", "node"):
        raise ValueError(f"unknown feature type: {feature_type}")
    return Query(**{feature_type: value}, include_graphs=tuple(include or ()), exclude_graphs=tuple(exclude or ()), limit=int(limit), offset=int(offset))


def graph_filter(include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Points of the graphs to include; else all but those to exclude, which keeps points without a graph."""
    if include:
        return F.col("graph").isin(*include)
    if exclude:
        return F.col("graph").isNull() | ~F.col("graph").isin(*exclude)
    return F.lit(True)


def has_iri(iri: str) -> Column:
    return F.array_contains("iri", iri)


def vector_literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scored(points: DataFrame, vector: list[float]) -> DataFrame:
    """Points with their cosine to a vector, in double precision; points without length have none."""
    return points.withColumn("score", cosine(as_doubles(F.col("vector")), vector_literal(vector))).where(F.col("score").isNotNull())


def top_k(points: DataFrame, vector: list[float], limit: int, offset: int = 0) -> DataFrame:
    """The best points, ties by id; each task passes on no more than limit + offset."""
    return scored(points, vector).orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def node_vector(points: DataFrame, iri: str) -> list[float]:
    """Vector of the first point with an IRI, whatever the graph."""
    found = points.where(has_iri(iri)).orderBy("id").select("vector").limit(1).collect()
    if not found:
        raise NotFoundError(f"URI not found: {iri}")
    return list(found[0].vector)


def search(points: DataFrame, query: Query, embedder=None) -> DataFrame:
    """Hits of a query, best first; a node is among its own hits."""
    if query.node is not None:
        vector = node_vector(points, query.node)
    elif embedder is None:
        raise ValueError("a text query needs an embedder")
    else:
        vector = embedder.embed(query.text)
    return top_k(points.where(graph_filter(query.include_graphs, query.exclude_graphs)), vector, query.limit, query.offset)


def _hashing(points: DataFrame, bucket: float, tables: int):
    """Points with ``unit``, their vector scaled to length 1, and the model that hashes it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    scaled = Normalizer(inputCol="raw", outputCol="unit", p=2.0).transform(points.withColumn("raw", array_to_vector(as_doubles(F.col("vector")))))
    return scaled, BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(scaled)


def hashed(points: DataFrame, bucket: float = 0.5, tables: int = 5) -> DataFrame:
    """id, graph, unit vector and buckets of points that have a length; a shared bucket makes a candidate of approximate_top_k."""
    from pyspark.ml.functions import vector_to_array

    usable = points.where(F.exists("vector", lambda x: x != 0))
    scaled, model = _hashing(usable, bucket, tables)
    places = F.array(*(vector_to_array(F.col("hashes")[t])[0] for t in range(tables)))
    return model.transform(scaled).select("id", "graph", vector_to_array("unit").alias("unit"), places.alias("buckets"))


def approximate_top_k(points: DataFrame, vector: list[float], limit: int, bucket: float = 0.5, tables: int = 5) -> DataFrame:
    """The best of locality-sensitive candidates, by the cosine of the stored vectors.

    Vectors are scaled to length 1, where Euclidean order is cosine order.
    """
    from pyspark.ml.linalg import Vectors

    scaled, model = _hashing(points, bucket, tables)
    size = sum(x * x for x in vector) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(scaled, Vectors.dense([x / size for x in vector]), limit)
    return top_k(near.select(*points.columns), vector, limit)


def resolve_graphs(every: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Graphs of a survey: those to include as given, else all but those to exclude."""
    if include:
        return list(include)
    gone = set(exclude or ())
    return [g for g in every if g not in gone]


def top_k_per_graph(points: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """The best points of each graph with their rank, in one pass (WindowGroupLimit before the exchange)."""
    place = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("score"), "id"))
    return scored(points, vector).withColumn("rank", place).where(F.col("rank") <= limit)


def survey(points: DataFrame, graphs: list[str], vector: list[float], limit: int = 5) -> DataFrame:
    """Columns ord, graph, best, rank and those of hits: graphs by their best hit, those without any last.

    Graphs may repeat or be unknown; each keeps its place in the list.
    """
    spark = points.sparkSession
    asked = spark.createDataFrame(list(enumerate(graphs)), "ord int, graph string")
    hits = top_k_per_graph(points.where(graph_filter(tuple(graphs))) if graphs else points.where(F.lit(False)), vector, limit)
    joined = asked.join(hits, "graph", "left")
    best = F.max("score").over(Window.partitionBy("ord"))
    return joined.withColumn("best", best).orderBy(F.desc_nulls_last("best"), "ord", "rank")


def facets(points: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns graph and count of points; the largest ones if limited."""
    counts = points.where(F.col("graph").isNotNull()).groupBy("graph").agg(F.count("*").alias("count"))
    return counts if limit is None else counts.orderBy(F.desc("count"), "graph").limit(limit)


def results(hits: DataFrame, *keep: str) -> DataFrame:
    """Hits as shown: first IRI, counts and texts filled in, after any columns to keep."""
    none = F.lit("")
    iris = F.coalesce("iri", F.array().cast("array<string>"))
    return hits.select(*keep, "id", "score", iris.alias("iris"), F.coalesce(F.get(iris, F.lit(0)), none).alias("primary_uri"), F.coalesce("iri_count", F.size(iris)).cast("long").alias("iri_count"), F.coalesce("label", none).alias("label"), F.coalesce("graph", none).alias("graph"), F.coalesce("repr", none).alias("repr"))


def api_rows(hits: DataFrame) -> DataFrame:
    """Results with the first IRI percent-encoded."""
    return results(hits).withColumn("encoded_uri", percent_encode(F.col("primary_uri")))


def sample_points(points: DataFrame, limit: int, seed: str = "0") -> DataFrame:
    """Up to ``limit`` uniformly drawn points of each graph."""
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("graph").orderBy(draw, "id"))
    return points.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def error_status(error: Exception) -> tuple[int, str]:
    """HTTP status and message for an error of a search."""
    if isinstance(error, NotFoundError):
        return 404, str(error)
    if isinstance(error, ConnectionError):
        return 500, "Could not reach the point store"
    return (400 if isinstance(error, ValueError) else 500), str(error)
