"""Surveys of an unknown graph: its types, their predicates, and uniform samples of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import IRI, LITERAL, RDF_TYPE
from ..functions.text import best_label
from ..sources.tables import written
from .config import GraphConfig
from .labels import predicate_texts
from .scan import first_literal, root_iris, type_pairs

SUBJECTS, VALUES = 5, 3


def graph_seed(triples: DataFrame) -> DataFrame:
    """One row with the counts of a graph and the seed drawn from them, 16 hex digits."""
    # one aggregate each: distinct counts together would send every triple once for each of them
    wanted = {"triples": F.count("*"), "subjects": F.count_distinct("s_kind", "s"), "predicates": F.count_distinct("p"), "objects": F.count_distinct("o_kind", "o")}
    each = [triples.agg(n.alias("n")).select(F.lit(name).alias("name"), "n") for name, n in wanted.items()]
    counts = reduce(DataFrame.unionByName, each).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in wanted))
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in ("triples", "subjects", "predicates", "objects")))
    return counts.withColumn("seed", F.substring(F.sha2(text, 256), 1, 16))


def drawn(seed: str, item: Column) -> Column:
    """A seeded number for an item; the least ones of a group are a uniform sample of it, in any order of rows."""
    return F.sha2(F.concat_ws(":", F.lit(seed), item), 256)


def sample_by(rows: DataFrame, group: str, item: str, count: int, seed: str) -> DataFrame:
    """Up to ``count`` rows of each group, uniformly; a task passes on no more than that of any group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(drawn(seed, F.col(item)), item))
    return rows.withColumn("place", place).where(F.col("place") <= count).drop("place")


def type_counts(triples: DataFrame) -> DataFrame:
    """Columns type and count."""
    return type_pairs(triples).groupBy("type").agg(F.count("*").alias("count"))


def type_samples(triples: DataFrame, seed: str, limit: int = SUBJECTS) -> DataFrame:
    """Columns type and s: sampled subjects of each type."""
    return sample_by(type_pairs(triples), "type", "s", limit, seed)


def sampled_edges(triples: DataFrame, samples: DataFrame) -> DataFrame:
    """Columns type, s, p, o_kind and o: what sampled subjects say, but for their types and blank nodes."""
    kept = triples.where((F.col("p") != RDF_TYPE) & F.col("o_kind").isin(IRI, LITERAL)).select("s", "p", "o_kind", "o")
    return kept.join(samples, "s")


def _sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("type").agg(F.count("*").alias("sampled"))


def _least_values(rows: DataFrame, keys: list[str], value: str, count: int) -> DataFrame:
    """Up to ``count`` least distinct values of each group, as a list."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    few = rows.select(*keys, value).distinct().withColumn("place", place).where(F.col("place") <= count)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))


def literal_predicates(edges: DataFrame, samples: DataFrame, values: int = VALUES) -> DataFrame:
    """Columns type, predicate, count, mean_per_subject and values of predicates with literals."""
    rows = edges.where(F.col("o_kind") == LITERAL)
    sums = rows.groupBy("type", "p").agg(F.count("*").alias("count"))
    lists = _least_values(rows, ["type", "p"], "o", values)
    out = sums.join(lists, ["type", "p"]).join(_sizes(samples), "type")
    return out.select("type", F.col("p").alias("predicate"), "count", (F.col("count") / F.col("sampled")).alias("mean_per_subject"), "values")


def object_predicates(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Columns type, predicate, count and mean_per_subject of predicates with IRIs."""
    sums = edges.where(F.col("o_kind") == IRI).groupBy("type", "p").agg(F.count("*").alias("count"))
    return sums.join(_sizes(samples), "type").select("type", F.col("p").alias("predicate"), "count", (F.col("count") / F.col("sampled")).alias("mean_per_subject"))


def object_types(triples: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns type, predicate, object_type and count."""
    types = type_pairs(triples).select(F.col("s").alias("o"), F.col("type").alias("object_type"))
    rows = edges.where(F.col("o_kind") == IRI).join(types, "o")
    return rows.groupBy("type", F.col("p").alias("predicate"), "object_type").agg(F.count("*").alias("count"))


def object_label_predicates(triples: DataFrame, edges: DataFrame, values: int = VALUES) -> DataFrame:
    """Columns type, predicate, label_predicate, count and values: literals of the objects."""
    said = triples.where((F.col("o_kind") == LITERAL) & (F.col("p") != RDF_TYPE)).select(F.col("s").alias("o"), F.col("p").alias("label_predicate"), F.col("o").alias("value"))
    rows = edges.where(F.col("o_kind") == IRI).select("type", F.col("p").alias("predicate"), "o").join(said, "o")
    keys = ["type", "predicate", "label_predicate"]
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).join(_least_values(rows, keys, "value", values), keys)


def sample_objects(triples: DataFrame, edges: DataFrame, limit: int = SUBJECTS) -> DataFrame:
    """Columns type, predicate, iri, label and types: up to ``limit`` least distinct objects."""
    rows = edges.where(F.col("o_kind") == IRI).select("type", F.col("p").alias("predicate"), F.col("o").alias("iri")).distinct()
    place = F.row_number().over(Window.partitionBy("type", "predicate").orderBy("iri"))
    few = rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    literal = first_literal(triples, GraphConfig().effective_label_predicates())
    types = type_pairs(triples).groupBy(F.col("s").alias("iri")).agg(F.array_sort(F.collect_set(F.col("type"))).alias("types"))
    joined = few.join(literal.withColumnRenamed("node", "iri"), "iri", "left").join(types, "iri", "left")
    return joined.select("type", "predicate", "iri", best_label(F.lit(IRI), F.col("iri"), F.col("literal")).alias("label"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def sample_types(triples: DataFrame, limit: int = SUBJECTS, values: int = VALUES, seed: str | None = None) -> DataFrame:
    """One nested row per type: label, count, sampled subjects, and what they say.

    The graph is read four times: for types, edges of the sampled subjects, what
    their objects say, and literals that name any of these.  Each is written, so
    that the joins that nest them never meet the whole graph.
    """
    if seed is None:
        seed = graph_seed(triples).first().seed
    config = GraphConfig()
    lists = type_samples(triples, seed, limit).groupBy("type").agg(F.array_sort(F.collect_list("s")).alias("sample_iris"))
    heads = written(type_counts(triples).join(lists, "type"), "sampled-types")
    samples = heads.select("type", F.explode("sample_iris").alias("s"))
    edges = written(sampled_edges(triples, samples), "sampled-edges")
    objects = written(edges.where(F.col("o_kind") == IRI).select(F.col("o").alias("s")).distinct(), "sampled-objects")
    around = written(triples.where((F.col("o_kind") == LITERAL) | (F.col("p") == RDF_TYPE)).join(objects, "s", "left_semi"), "around-objects")
    predicates = edges.select("p").union(around.select("p")).distinct()
    shown = [predicates, heads.select("type"), around.where(F.col("p") == RDF_TYPE).select("o"), objects]
    shown = written(reduce(DataFrame.union, shown).toDF("s").distinct(), "shown-terms")
    label_predicates = config.effective_label_predicates()
    naming = triples.where((F.col("o_kind") == LITERAL) & F.col("p").isin(*label_predicates))
    naming = written(naming.join(shown, "s", "left_semi"), "naming")
    texts = predicate_texts(naming, predicates, config).select(F.col("p").alias("predicate"), F.col("text").alias("label"))
    literal = first_literal(naming, label_predicates)

    def ordered(rows: DataFrame, keys: list[str], name: str, *fields: str) -> DataFrame:
        """Rows nested in a list, most frequent first."""
        item = F.struct((-F.col("count")).alias("order"), *fields)
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("order")).alias(name))

    lits = ordered(literal_predicates(edges, samples, values).join(texts, "predicate"), ["type"], "literal_predicates", "predicate", "label", "count", "mean_per_subject", "values")
    keys = ["type", "predicate"]
    typed = object_types(around, edges).join(literal, F.col("object_type") == F.col("node"), "left").withColumn("label", best_label(F.lit(IRI), F.col("object_type"), F.col("literal")))
    typed = ordered(typed, keys, "object_types", "object_type", "label", "count")
    said = object_label_predicates(around, edges, values).join(texts.withColumnRenamed("predicate", "label_predicate"), "label_predicate")
    said = ordered(said, keys, "object_label_predicates", "label_predicate", "label", "count", "values")
    few = sample_objects(around, edges, limit).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("iri", "label", "types"))).alias("sample_objects"))
    objs = object_predicates(edges, samples).join(texts, "predicate").join(typed, keys, "left").join(said, keys, "left").join(few, keys, "left")
    objs = ordered(objs, ["type"], "object_predicates", "predicate", "label", "count", "mean_per_subject", "object_types", "object_label_predicates", "sample_objects")
    heads = heads.join(literal, F.col("type") == F.col("node"), "left").withColumn("label", best_label(F.lit(IRI), F.col("type"), F.col("literal"))).drop("node", "literal")
    return heads.join(lits, "type", "left").join(objs, "type", "left").orderBy("type")


def sample_target_roots(triples: DataFrame, targets: dict[str, str], limit: int, seed: str) -> DataFrame:
    """Columns target, type and s: sampled roots of each target, given as name to type."""
    out = None
    for name, type_iri in targets.items():
        rows = root_iris(triples, type_iri).select(F.lit(name).alias("target"), F.lit(type_iri).alias("type"), "s")
        out = rows if out is None else out.unionByName(rows)
    return sample_by(out, "target", "s", limit, seed)
