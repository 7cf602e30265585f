"""Pattern scans over triples; filters reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import IRI, LITERAL, RDF_TYPE


def root_iris(triples: DataFrame, type_iri: str) -> DataFrame:
    """Column s: the IRIs of a type, each once; blank nodes are none."""
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri) & (F.col("o_kind") == IRI) & (F.col("s_kind") == IRI)).select("s").distinct()


def first_roots(roots: DataFrame, limit: int | None) -> DataFrame:
    """The first roots in order of IRI; all if no limit is given."""
    return roots if limit is None else roots.orderBy("s").limit(limit)


def predicate_objects(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """All triples of the given subjects (column s)."""
    return triples.join(subjects, "s", "left_semi")


def objects(triples: DataFrame, subjects: DataFrame, predicate: str) -> DataFrame:
    """Objects of one predicate for the given subjects."""
    return predicate_objects(triples.where(F.col("p") == predicate), subjects).select("s", "o_kind", "o")


def type_pairs(triples: DataFrame) -> DataFrame:
    """Columns s and type: every IRI and each IRI type of it."""
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("s_kind") == IRI) & (F.col("o_kind") == IRI)).select("s", F.col("o").alias("type")).distinct()


def types_of(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Columns s and types (sorted) of the given nodes; nodes without a type are not there."""
    pairs = triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI)).select("s", F.col("o").alias("type"))
    return pairs.join(nodes, "s", "left_semi").groupBy("s").agg(F.array_sort(F.collect_set("type")).alias("types"))


def first_literal(triples: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """Columns node and literal: the least literal of the first predicate that has one, in any language."""
    if not predicates:
        return triples.where(F.lit(False)).select(F.col("s").alias("node"), F.col("o").alias("literal"))
    order = F.array_position(F.array(*map(F.lit, predicates)), F.col("p"))
    found = triples.where((F.col("o_kind") == LITERAL) & F.col("p").isin(*predicates))
    return found.groupBy(F.col("s").alias("node")).agg(F.min(F.struct(order.alias("ord"), F.col("o"))).o.alias("literal"))


def walked(predicate: Column, include: tuple[str, ...], ignore: tuple[str, ...]) -> Column:
    """Whether a predicate is walked: in the allowlist if there is one, and not in the blocklist."""
    keep = predicate.isin(*include) if include else F.lit(True)
    return keep & ~predicate.isin(*ignore) if ignore else keep
