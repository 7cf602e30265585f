"""Labels of nodes: by predicates, by profiles of their type, by templates, by IRI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import BNODE, IRI, LITERAL, RDF_TYPE
from ..functions.text import best_label, display_label, humanize, normalize_label, render_template
from ..sources.tables import written
from .config import GraphConfig, LabelProfile, Materialization, TargetConfig
from .scan import first_literal

#: Most rounds in which profile labels may build on each other before that is an error.
PROFILE_ROUNDS = 32


def predicate_texts(triples: DataFrame, predicates: DataFrame, config: GraphConfig) -> DataFrame:
    """Columns p and text: readable lower-case names of the given predicates (column p)."""
    named = predicates.select(F.col("p").alias("node")).distinct()
    labels = first_literal(triples.join(named.withColumnRenamed("node", "s"), "s", "left_semi"), config.effective_label_predicates())
    label = best_label(F.lit(IRI), F.col("node"), F.col("literal"))
    text = F.lower(humanize(F.coalesce(label, F.col("node"))))
    return named.join(labels, "node", "left").select(F.col("node").alias("p"), text.alias("text"))


def _profile_of(triples: DataFrame, profiles: list[LabelProfile]) -> DataFrame:
    """Columns node and profile: place of the profile of each node's first type that has one."""
    first: dict[str, int] = {}
    for i, p in enumerate(profiles):
        first.setdefault(p.type, i)
    place = F.create_map(*(x for t, i in first.items() for x in (F.lit(t), F.lit(i))))
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI) & F.col("o").isin(*first))
    return typed.groupBy(F.col("s").alias("node")).agg(F.min("o").alias("type")).select("node", F.element_at(place, F.col("type")).alias("profile"))


def field_values(triples: DataFrame, fields: dict[str, str], labels: DataFrame) -> DataFrame:
    """Column node and one column for each alias: the least display label of the predicate's objects.

    labels: columns node and label of nodes that have one; others show their IRI.
    """
    wanted = triples.where(F.col("p").isin(*set(fields.values())) & (F.col("o_kind") != BNODE))
    known = labels.select(F.col("node").alias("o"), "label")
    literals = wanted.where(F.col("o_kind") == LITERAL).select("s", "p", normalize_value(F.col("o")).alias("shown"))
    nodes = wanted.where(F.col("o_kind") == IRI).select("s", "p", "o").join(known, "o", "left")
    shown = F.coalesce("label", display_label(F.lit(IRI), F.col("o"), F.lit(None).cast("string")))
    every = literals.unionByName(nodes.select("s", "p", shown.alias("shown"))).where(F.length("shown") > 0)
    picks = [F.min(F.when(F.col("p") == p, F.col("shown"))).alias(_column(a)) for a, p in fields.items()]
    return every.groupBy(F.col("s").alias("node")).agg(*picks)


def normalize_value(value: Column) -> Column:
    """A literal as shown: normalised, or as it is where nothing is left."""
    label = normalize_label(value)
    return F.when(F.length(label) > 0, label).otherwise(value)


def _column(alias: str) -> str:
    return f"field_{alias}"


def templated(triples: DataFrame, nodes: DataFrame, template: str, fields: dict[str, str], labels: DataFrame) -> DataFrame:
    """Columns node and text (null where empty) of a template for the given nodes (column node)."""
    values = {a: F.col(_column(a)) for a in fields}
    if not fields:
        return nodes.select("node", render_template(template, {}).alias("text"))
    found = field_values(triples.join(nodes.select(F.col("node").alias("s")), "s", "left_semi"), fields, labels)
    return nodes.select("node").join(found, "node", "left").select("node", render_template(template, values).alias("text"))


def plain_labels(triples: DataFrame, config: GraphConfig) -> DataFrame:
    """Columns node and label of the nodes with a literal label; one row each."""
    found = first_literal(triples, config.effective_label_predicates())
    return found.select("node", display_label(F.lit(IRI), F.col("node"), F.col("literal")).alias("label"))


def _profiled(triples: DataFrame, chosen: DataFrame, profiles: list[LabelProfile], labels: DataFrame) -> DataFrame:
    """Columns node and text (null where empty) of nodes by their chosen profile, all profiles in one pass."""
    fields = {p: i for i, p in enumerate(dict.fromkeys(p for x in profiles for p in x.fields.values()))}
    found = chosen
    if fields:
        values = field_values(triples.join(chosen.select(F.col("node").alias("s")), "s", "left_semi"), {str(i): p for p, i in fields.items()}, labels)
        found = chosen.join(values, "node", "left")
    text = F.lit(None).cast("string")
    for i, x in enumerate(profiles):
        columns = {a: F.col(_column(str(fields[p]))) for a, p in x.fields.items()}
        text = F.when(F.col("profile") == i, render_template(x.template, columns)).otherwise(text)
    return found.select("node", text.alias("text"))


def _profile_texts(triples: DataFrame, chosen: DataFrame, profiles: list[LabelProfile], plain: DataFrame, rounds: int) -> DataFrame:
    """Columns node and text of nodes with a profile, once a further round changes none.

    Rounds read only the fields of those nodes and the plain labels of what they point to.
    """
    wanted = F.col("p").isin(*(p for x in profiles for p in x.fields.values())) & (F.col("o_kind") != BNODE)
    fields = written(triples.where(wanted).join(chosen.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o_kind", "o"), "fields")
    ends = fields.where(F.col("o_kind") == IRI).select(F.col("o").alias("node")).distinct()
    near = written(plain.join(ends, "node", "left_semi"), "ends")
    texts = written(_profiled(fields, chosen, profiles, near).where(F.col("text").isNotNull()), "texts")
    if ends.join(chosen, "node", "left_semi").isEmpty():
        return texts  # no profile builds on another
    for _ in range(rounds):
        labels = near.join(texts, "node", "full").select("node", F.coalesce("text", "label").alias("label"))
        after = written(_profiled(fields, chosen, profiles, labels).where(F.col("text").isNotNull()), "texts")
        before, texts = texts, after
        both = after.join(before.withColumnRenamed("text", "before"), "node", "full")
        if both.where(~F.col("text").eqNullSafe(F.col("before"))).isEmpty():
            return texts
    raise ValueError(f"label profiles have not settled after {rounds} rounds: nodes refer to each other in a circle, or in longer chains")


def node_labels(triples: DataFrame, config: GraphConfig, profiles: list[LabelProfile] = (), rounds: int = PROFILE_ROUNDS) -> DataFrame:
    """Columns node and label: display labels of nodes as objects, profiles by type included.

    Profiles may name nodes that have profiles themselves; rounds build on each
    other until no label changes, and ValueError says that they do not settle.
    """
    plain = plain_labels(triples, config)
    if not profiles:
        return plain
    # rounds read what others read too, so that each is written once
    plain = written(plain, "labels")
    chosen = written(_profile_of(triples, list(profiles)), "profiles")
    texts = _profile_texts(triples, chosen, list(profiles), plain, rounds)
    return plain.join(texts, "node", "full").select("node", F.coalesce("text", "label").alias("label"))


def root_labels(triples: DataFrame, roots: DataFrame, config: TargetConfig, setup: Materialization | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Columns s and label of the roots (column s).

    In order: the profile that the target names, else that of the root's type;
    the target's template; label predicates; the IRI.
    """
    profiles = list(setup.label_profiles.values()) if setup else []
    labels = node_labels(triples, config, profiles) if labels is None else labels
    nodes = roots.select(F.col("s").alias("node")).distinct()
    base = nodes.join(plain_labels(triples, config).withColumnRenamed("label", "plain"), "node", "left")
    tries: list[Column] = []
    named = setup.label_profiles.get(config.label_profile) if setup and config.label_profile else None
    if named is not None:
        base = base.join(templated(triples, nodes, named.template, named.fields, labels).withColumnRenamed("text", "named"), "node", "left")
        tries.append(F.col("named"))
    elif profiles:
        chosen = _profile_of(triples, profiles).join(nodes, "node", "left_semi")
        texts = _profiled(triples, chosen, profiles, labels)
        base = base.join(texts.withColumnRenamed("text", "typed"), "node", "left")
        tries.append(F.col("typed"))
    if config.label_template:
        base = base.join(templated(triples, nodes, config.label_template, config.label_fields, labels).withColumnRenamed("text", "own"), "node", "left")
        tries.append(F.col("own"))
    fallback = display_label(F.lit(IRI), F.col("node"), F.lit(None).cast("string"))
    return base.select(F.col("node").alias("s"), F.coalesce(*tries, "plain", fallback).alias("label"))
