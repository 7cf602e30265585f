"""Retrieval quality: recall of approximate hits against exact ones, and what they miss.

Hits have the columns query_id, target_graph, mode, rank, id and score, where
mode is knn, in_graph or all_graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Depths at which recall is taken, and hits of each search.
DEPTHS, HITS = (1, 5, 10, 20, 50), 50
RUN = "query_id string, target_graph string, mode string, rank int, id string, score double"
MODES = ("knn", "in_graph", "all_graph")
#: Queries and points that meet in one block.
QUERY_BLOCK, POINT_BLOCK = 1024, 1 << 16


def top_rows(hits: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """The first hits of each search with what is known of their points."""
    known = points.select("id", "iri", "label", "graph", "repr")
    few = hits.where(F.col("rank") <= n).select("query_id", "mode", "rank", "score", "id")
    return few.join(known, "id", "left").select("query_id", "mode", "rank", "score", "iri", "label", "graph", "repr")


def write_run(hits: DataFrame, path: str) -> None:
    """Keeps the hits of a run as a folder of JSON lines."""
    hits.select(*(f.split()[0] for f in RUN.split(", "))).write.json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The hits of a run that was kept; a line that is none raises an error."""
    return spark.read.schema(RUN).json(path, mode="FAILFAST")


def recall_table(hits: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Columns query_id, target_graph, mode, k, overlap and recall; recall is null without exact hits."""
    ks = F.explode(F.array(*map(F.lit, depths))).alias("k")
    cut = hits.select("*", ks).where(F.col("rank") <= F.col("k"))
    exact = cut.where(F.col("mode") == "knn").select("query_id", "target_graph", "k", "id")
    size = exact.groupBy("query_id", "target_graph", "k").agg(F.count("*").alias("size"))
    modes = hits.where(F.col("mode") != "knn").select("query_id", "mode").distinct()
    found = cut.where(F.col("mode") != "knn").select("query_id", "mode", "k", "id").distinct()
    common = found.join(exact.select("query_id", "k", "id").distinct(), ["query_id", "k", "id"]).groupBy("query_id", "mode", "k").agg(F.count("*").alias("overlap"))
    every = size.join(modes, "query_id").join(common, ["query_id", "mode", "k"], "left")
    overlap = F.coalesce("overlap", F.lit(0)).cast("long")
    return every.select("query_id", "target_graph", "mode", "k", overlap.alias("overlap"), (overlap / F.nullif(F.col("size"), F.lit(0))).alias("recall"))


def missed_points(hits: DataFrame) -> DataFrame:
    """Exact hits that score above the worst hit over all graphs and are not among them."""
    every = hits.where(F.col("mode") == "all_graph")
    worst = every.groupBy("query_id").agg(F.min("score").alias("worst"))
    exact = hits.where(F.col("mode") == "knn").select("query_id", "target_graph", "rank", "id", "score")
    above = exact.join(worst, "query_id").where(F.col("score") > F.col("worst"))
    return above.join(every.select("query_id", "id"), ["query_id", "id"], "left_anti")


def score_ranges(hits: DataFrame) -> DataFrame:
    """Columns query_id, mode, low, high and range, as in ``0.12 to 0.98``."""
    sums = hits.groupBy("query_id", "mode").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return sums.withColumn("range", F.format_string("%.2f to %.2f", "low", "high"))


def summary(hits: DataFrame, by_graph: bool = False, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Columns (target_graph,) k, in_graph_recall, all_graph_recall and queries: means, 0 where there is none."""
    keys = ["target_graph", "k"] if by_graph else ["k"]

    def mean(mode: str):
        return F.coalesce(F.avg(F.when(F.col("mode") == mode, F.col("recall"))), F.lit(0.0)).alias(f"{mode}_recall")

    return recall_table(hits, depths).groupBy(*keys).agg(mean("in_graph"), mean("all_graph"), F.count_distinct("query_id").alias("queries"))


def missed_summary(hits: DataFrame) -> DataFrame:
    """One row: mean and greatest number of missed points over the queries."""
    queries = hits.where(F.col("mode") == "knn").select("query_id").distinct()
    counts = missed_points(hits).groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.join(counts, "query_id", "left").agg(F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_missed"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_missed"))


def report(hits: DataFrame, depths: tuple[int, ...] = DEPTHS) -> str:
    """A Markdown report; a few numbers of each query reach the driver."""
    out = ["# Retrieval evaluation", "", "| k | in graph | all graphs |", "|---|---|---|"]
    out += [f"| {r.k} | {r.in_graph_recall:.3f} | {r.all_graph_recall:.3f} |" for r in summary(hits, False, depths).orderBy("k").collect()]
    missed = missed_summary(hits).first()
    out += ["", f"Missed over all graphs: {missed.mean_missed:.2f} on average, {missed.max_missed} at most.", "", "| graph | k | in graph | all graphs |", "|---|---|---|---|"]
    out += [f"| {r.target_graph} | {r.k} | {r.in_graph_recall:.3f} | {r.all_graph_recall:.3f} |" for r in summary(hits, True, depths).orderBy("target_graph", "k").collect()]
    out += ["", "| query | search | scores |", "|---|---|---|"]
    out += [f"| {r.query_id} | {r.mode} | {r.range} |" for r in score_ranges(hits).orderBy("query_id", "mode").collect()]
    return "\n".join(out) + "\n"


def run(points: DataFrame, queries: list[tuple[str, str, list[float]]], hits: int = HITS) -> DataFrame:
    """Hits of exact and approximate searches for (query id, target graph, vector)."""
    from .search import approximate_top_k, graph_filter, top_k

    out = None
    for name, graph, vector in queries:
        inside = points.where(graph_filter((graph,)))
        for mode, found in (("knn", top_k(inside, vector, hits)), ("in_graph", approximate_top_k(inside, vector, hits)), ("all_graph", approximate_top_k(points, vector, hits))):
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            rows = found.select(F.lit(name).alias("query_id"), F.lit(graph).alias("target_graph"), F.lit(mode).alias("mode"), "id", "score").withColumn("rank", rank)
            out = rows if out is None else out.unionByName(rows)
    return out


def run_all(points: DataFrame, is_query: Column, hits: int = HITS) -> DataFrame:
    """As ``run`` for all points that are queries, each with its graph as target, in blocks against all points.

    A pair is scored once, rounded to nine digits; the approximate searches rank
    those pairs that share a bucket, as approximate_top_k does.
    """
    from ..sources.tables import written
    from .search import hashed

    rows = points.where(F.exists("vector", lambda x: x != 0))
    if rows.isEmpty():
        fields = points.select(F.col("id").alias("query_id"), F.col("graph").alias("target_graph"), F.lit("").alias("mode"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return fields.where(F.lit(False))
    rows = hashed(points)
    asked = rows.where(is_query)
    across, down = (max(1, -(-x.count() // n)) for x, n in ((asked, QUERY_BLOCK), (rows, POINT_BLOCK)))

    def side(df: DataFrame, point: bool) -> DataFrame:
        own, other = (down, across) if point else (across, down)
        mine, every = F.pmod(F.xxhash64("id"), F.lit(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        df = df.withColumn("mine", mine).withColumn("every", every)
        job = F.col("mine") * across + F.col("every") if point else F.col("every") * across + F.col("mine")
        return df.select(job.alias("job"), F.lit(point).alias("point"), "id", "graph", "unit", "buckets")

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(len(column), -1)

    def best(scores: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        if len(places) > hits:
            cut = np.partition(scores[places], len(places) - hits)[len(places) - hits]
            places = places[scores[places] >= cut]
        return places[np.lexsort((order[places], -scores[places]))][:hits]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by job, its queries before its points, to the best of every query of the job."""
        now, held = None, []
        kept: list[list[list[tuple[float, object]]]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for queries, tops in zip(held, kept, strict=True):
                which = [i for i, top in enumerate(tops) for _ in top]
                take = pa.array([i // len(MODES) for i in which], pa.int64())
                modes = pa.array([MODES[i % len(MODES)] for i in which], pa.string())
                ids = pa.array([x for top in tops for _, x in top], queries.schema.field("id").type)
                scores = pa.array([-x for top in tops for x, _ in top], pa.float64())
                yield pa.RecordBatch.from_arrays([queries.column(2).take(take), queries.column(3).take(take), modes, ids, scores], names=["query_id", "target_graph", "mode", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            job, point = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edge = np.flatnonzero(np.append(True, (job[1:] != job[:-1]) | (point[1:] != point[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(job)), strict=True):
                part = batch.slice(a, b - a)
                if job[a] != now:
                    yield from out()
                    now, held, kept = job[a], [], []
                if not point[a]:
                    held.append(part)
                    kept.append([[] for _ in range(part.num_rows * len(MODES))])
                    continue
                for queries, tops in zip(held, kept, strict=True):
                    for i, new in enumerate(found(queries, part)):
                        if new:
                            tops[i] = sorted(tops[i] + new)[:hits]
        yield from out()

    def found(queries: pa.RecordBatch, part: pa.RecordBatch) -> Iterator[list[tuple[float, object]]]:
        """For every query and mode, the best of some points: score negated, and id."""
        ids = part.column(2).to_pylist()
        _, order = np.unique(np.array(ids), return_inverse=True)
        graphs = np.array(part.column(3).to_pylist(), dtype=object)
        units, buckets = matrix(part.column(4)), matrix(part.column(5))
        asked_units, asked_buckets, targets = matrix(queries.column(4)), matrix(queries.column(5)), queries.column(3).to_pylist()
        for q, target in enumerate(targets):
            score = np.round(units @ asked_units[q], 9)
            near = (buckets == asked_buckets[q]).any(axis=1)
            same = (graphs == target) if target is not None else np.zeros(len(graphs), dtype=bool)
            for use in (same, same & near, near):
                top = best(score, np.flatnonzero(use), order)
                yield [(-x, ids[i]) for x, i in zip(score[top].tolist(), top.tolist(), strict=True)]

    kind = rows.schema["id"].dataType.simpleString()
    pairs = side(asked, False).unionByName(side(rows, True)).repartition("job").sortWithinPartitions("job", "point")
    pairs = pairs.mapInArrow(meet, f"query_id {kind}, target_graph string, mode string, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("score"), "id"))
    return written(pairs.withColumn("rank", rank).where(F.col("rank") <= hits), "hits")
