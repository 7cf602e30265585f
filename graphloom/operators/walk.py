"""Walks along outgoing edges, with a deterministic limit per subject and predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import LITERAL
from ..functions.text import stable_score
from .config import GraphConfig
from .scan import walked


def edges(triples: DataFrame, config: GraphConfig) -> DataFrame:
    """Columns s, p, o_kind, o and rank: the edges a walk takes from each subject.

    With a limit, objects are those of least score, in order of score, blank
    nodes included; without one, in order of value.  Spark keeps no more than
    the limit of each group before the exchange (WindowGroupLimit).
    """
    kept = triples.where(walked(F.col("p"), config.include_predicates, config.ignore_predicates)).select("s", "p", "o_kind", "o")
    group = Window.partitionBy("s", "p")
    if config.predicate_limit is None:
        # no group is cut, so the order of values serves as the rank
        return kept.withColumn("rank", F.concat_ws("\t", "o", "o_kind"))
    scored = kept.withColumn("rank", stable_score(F.col("s"), F.col("p"), F.col("o")))
    place = F.row_number().over(group.orderBy("rank", "o_kind"))
    return scored.withColumn("place", place).where(F.col("place") <= config.predicate_limit).drop("place")


def walk_one(triples: DataFrame, roots: DataFrame, config: GraphConfig) -> DataFrame:
    """The edges of the given roots (column s), one level deep."""
    return edges(triples.join(roots, "s", "left_semi"), config)


def walk_paths(triples: DataFrame, roots: DataFrame, config: GraphConfig) -> DataFrame:
    """Columns root, level, s, p, o_kind, o and path, to a depth of expansion_limit.

    Paths multiply, as no visited set is kept; limits apply before each join.
    Ordering by root and path is depth-first order.
    """
    steps = edges(triples, config)
    front = steps.join(roots.select("s").distinct(), "s").select(F.col("s").alias("root"), F.lit(0).alias("level"), "s", "p", "o_kind", "o", F.array(F.struct("p", "rank")).alias("path"))
    out = front
    for level in range(1, config.expansion_limit + 1):
        heads = front.where(F.col("o_kind") != LITERAL).select("root", F.col("o").alias("s"), F.col("path").alias("before"))
        front = heads.join(steps, "s").select("root", F.lit(level).alias("level"), "s", "p", "o_kind", "o", F.concat("before", F.array(F.struct("p", "rank"))).alias("path"))
        out = out.unionByName(front)
    return out
