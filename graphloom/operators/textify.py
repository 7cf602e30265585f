"""Documents from graphs: one text for each root, and records of roots with the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import BNODE, IRI, LITERAL
from ..functions.text import fallback_label, stable_score, text_digest
from ..sources.tables import written
from .config import GraphConfig, Materialization, TargetConfig
from .labels import node_labels, normalize_value, predicate_texts, root_labels
from .sampling import graph_seed, sample_target_roots
from .scan import first_literal, first_roots, root_iris
from .walk import walk_one

#: IRIs kept of each record.
IRI_CAP = 10


def shown_objects(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the column shown, the display label of each object; blank nodes and empty ones go."""
    known = labels.select(F.col("node").alias("o"), "label")
    literals = steps.where(F.col("o_kind") == LITERAL).withColumn("shown", normalize_value(F.col("o")))
    nodes = steps.where(F.col("o_kind") == IRI).join(known, "o", "left")
    fallback = fallback_label(F.col("o"))
    shown = F.coalesce("label", F.when(F.length(fallback) > 0, fallback), "o")
    nodes = nodes.withColumn("shown", shown).select(literals.columns)
    return literals.unionByName(nodes).where(F.length("shown") > 0)


def body_lines(triples: DataFrame, steps: DataFrame, labels: DataFrame, config: GraphConfig) -> DataFrame:
    """Columns s and body: a line for each edge, by predicate and rank.

    The edges are written once, as both their predicates and their lines are read.
    """
    steps = written(steps, "steps")
    texts = predicate_texts(triples, steps, config)
    lines = shown_objects(steps, labels).join(texts, "p").select("s", "p", "rank", F.concat("text", F.lit(": "), "shown").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "rank", "line")))
    return lines.groupBy("s").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("body"))


def documents(triples: DataFrame, config: TargetConfig, setup: Materialization | None = None, limit: int | None = None, name: str = "", labels: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Columns target, iri, label, embedding_text and digest: a row for each root of a target.

    Only the root's own edges are written, whatever the walk's depth.  roots:
    column s, to use instead of the first ones of the target's type.
    """
    roots = first_roots(root_iris(triples, config.type), limit) if roots is None else roots
    if labels is None:
        labels = node_labels(triples, config, list(setup.label_profiles.values()) if setup else [])
    heads = root_labels(triples, roots, config, setup, labels)
    bodies = body_lines(triples, walk_one(triples, roots, config), labels, config)
    first = F.when(F.length("label") > 0, F.concat(F.lit("label: "), "label"))
    text = F.concat_ws("\n", first, "body")
    return heads.join(bodies, "s", "left").select(F.lit(name).alias("target"), F.col("s").alias("iri"), "label", text.alias("embedding_text"), text_digest(text).alias("digest"))


def group_documents(docs: DataFrame, cap: int = IRI_CAP) -> DataFrame:
    """Columns iris (the least ones, up to the cap), label, embedding_text, iri_count and digest.

    Roots with the same text are one record, over all targets; an IRI counts
    once.  No task gathers more than the cap of any record's IRIs.
    """
    pairs = docs.groupBy("digest", "iri").agg(F.min("label").alias("label"), F.first("embedding_text").alias("embedding_text"))
    sums = pairs.groupBy("digest").agg(F.min("label").alias("label"), F.min("embedding_text").alias("embedding_text"), F.count("*").alias("iri_count"))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("iri"))
    least = pairs.select("digest", "iri").withColumn("place", place).where(F.col("place") <= cap)
    lists = least.groupBy("digest").agg(F.array_sort(F.collect_list("iri")).alias("iris"))
    return sums.join(lists, "digest").select("iris", "label", "embedding_text", "iri_count", "digest")


def textify(triples: DataFrame, setup: Materialization, target: str | None = None, limit: int | None = None, cap: int = IRI_CAP) -> DataFrame:
    """Records of one target, or of all of them together."""
    every = None
    known: dict[tuple[str, ...], DataFrame] = {}  # targets with the same label predicates share labels
    for name, config in setup.targets(target):
        by = config.effective_label_predicates()
        if by not in known:
            known[by] = node_labels(triples, config, list(setup.label_profiles.values()))
        docs = documents(triples, config, setup, limit, name, known[by])
        every = docs if every is None else every.unionByName(docs)
    return group_documents(every, cap)


def sample_targets(triples: DataFrame, setup: Materialization, limit: int, seed: str | None = None, cap: int = IRI_CAP) -> DataFrame:
    """Columns target, type and records: what uniformly sampled roots of each target become, as a list.

    Roots are grouped by text within their target; records are in record order.
    A target without roots has an empty list.
    """
    if seed is None:
        seed = graph_seed(triples).first().seed
    types = {name: config.type for name, config in setup.targets()}
    drawn = written(sample_target_roots(triples, types, limit, seed), "sample")
    item = F.struct("embedding_text", "iris", "label", "iri_count", "digest")
    every = None
    for name, config in setup.targets():
        roots = drawn.where(F.col("target") == name).select("s")
        records = group_documents(documents(triples, config, setup, name=name, roots=roots), cap)
        one = records.agg(F.array_sort(F.collect_list(item)).alias("records")).select(F.lit(name).alias("target"), F.lit(config.type).alias("type"), "records")
        every = one if every is None else every.unionByName(one)
    return every


def truncated(records: DataFrame, cap: int = IRI_CAP) -> DataFrame:
    """Records that stand for more IRIs than they list."""
    return records.where(F.col("iri_count") > cap)


def in_record_order(records: DataFrame) -> DataFrame:
    return records.orderBy("embedding_text", "iris")


# -- the older rendering -------------------------------------------------------

#: Objects of each predicate in the older rendering.
LEGACY_CAP = 5


def legacy_documents(triples: DataFrame, type_iri: str, label_predicates: tuple[str, ...], skip: tuple[str, ...], given: str, family: str, cap: int = LEGACY_CAP) -> DataFrame:
    """Columns iri and embedding_text in the older form.

    The first line is ``entity:`` with a label by predicates, else given and
    family names; blank nodes go before objects are cut, and objects are put in
    order of score only where there are more than the cap.
    """
    roots = root_iris(triples, type_iri)
    mine = triples.join(roots, "s", "left_semi").where(~F.col("p").isin(*skip) & (F.col("o_kind") != BNODE)).select("s", "p", "o_kind", "o")
    group = Window.partitionBy("s", "p")
    score = stable_score(F.col("s"), F.col("p"), F.col("o"))
    kept = mine.withColumns({"score": score}).withColumn("place", F.row_number().over(group.orderBy("score", "o_kind"))).where(F.col("place") <= cap + 1)
    kept = kept.withColumn("over", F.max("place").over(group) > cap).where(F.col("place") <= cap)
    steps = kept.withColumn("rank", F.when(F.col("over"), F.col("score")).otherwise(F.col("o"))).drop("score", "place", "over")
    names = triples.where((F.col("o_kind") == LITERAL) & F.col("p").isin(given, family)).groupBy(F.col("s").alias("node")).agg(F.min(F.when(F.col("p") == given, F.col("o"))).alias("given"), F.min(F.when(F.col("p") == family, F.col("o"))).alias("family"))
    literal = first_literal(triples, label_predicates)
    both = literal.join(names, "node", "full").select("node", F.coalesce(F.nullif("literal", F.lit("")), F.nullif(F.concat_ws(" ", "given", "family"), F.lit(""))).alias("label"))
    config = GraphConfig(label_predicates=label_predicates, include_rdfs_label=False)
    bodies = body_lines(triples, steps, both.where(F.col("label").isNotNull()), config)
    head = both.select(F.col("node").alias("s"), "label")
    joined = roots.join(head, "s", "left").join(bodies, "s", "left")
    text = F.concat_ws("\n", F.when(F.length("label") > 0, F.concat(F.lit("entity: "), "label")), "body")
    return joined.select(F.col("s").alias("iri"), text.alias("embedding_text"))


def legacy_distinct(docs: DataFrame) -> DataFrame:
    """The first IRI of each distinct text."""
    return docs.groupBy("embedding_text").agg(F.min("iri").alias("iri")).select("iri", "embedding_text")
