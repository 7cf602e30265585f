"""Queries by name over the driver's tables, with the SQL each must agree with.

The graph is the direct mapping of the tables; points are the table of
embeddings with the label as graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, RDFS_LABEL
from ..functions.text import POINT_NAMESPACE, fallback_label, humanize, iri_fragment, point_id, shard_of, stable_score, text_digest
from ..operators import evaluate, labels, sampling, scan, search, textify, walk
from ..operators.config import GraphConfig, Materialization, TargetConfig
from ..sources.tables import written
from ..sources.triples import BASE, table_triples

V = BASE + "v/"
FLAGSHIP = "textify_grouped"
SEED = "17"

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- inputs --------------------------------------------------------------------

SMALL = ("region", "nation", "customer", "supplier")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    iri = F.concat(F.lit("vec/"), F.col("vec_id").cast("string"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("graph"), F.array(iri).alias("iri"), iri.alias("label"), F.lit(None).cast("string").alias("repr"), F.lit(1).cast("long").alias("iri_count"))


def _vector(spark: SparkSession, sf_dir: str, i: int) -> list[float]:
    return search.node_vector(_points(spark, sf_dir), f"vec/{i}")


_P = "p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM p WHERE vec_id = {0}), s AS (SELECT p.vec_id AS id, CAST(p.label AS VARCHAR) AS graph, list_cosine_similarity(p.v, q.qv) AS score FROM p, q)"


def _hits(found: DataFrame) -> DataFrame:
    return found.select("id", "graph", F.round("score", 6).alias("score"))


def _knn_sql(where: str, limit: int, offset: int = 0, i: int = 0) -> str:
    return f"WITH {_P.format(i)} SELECT id, graph, round(score, 6) AS score FROM (SELECT * FROM s WHERE {where} ORDER BY s.score DESC, id LIMIT {limit} OFFSET {offset}) t"


def _t(*tables: str, reverse: bool = False) -> str:
    """The triples of tables as a CTE named t."""
    b, v = BASE, V
    made = {
        "region": [(f"'{b}region/' || r_regionkey", "Region", [(RDFS_LABEL, "r_name")], [])],
        "nation": [(f"'{b}nation/' || n_nationkey", "Nation", [(RDFS_LABEL, "n_name")], [("inRegion", f"'{b}region/' || n_regionkey")])],
        "customer": [(f"'{b}customer/' || c_custkey", "Customer", [(RDFS_LABEL, "c_name"), (v + "marketSegment", "c_mktsegment")], [("inNation", f"'{b}nation/' || c_nationkey")])],
        "supplier": [(f"'{b}supplier/' || s_suppkey", "Supplier", [(RDFS_LABEL, "s_name")], [("inNation", f"'{b}nation/' || s_nationkey")])],
        "part": [(f"'{b}part/' || p_partkey", "Part", [(RDFS_LABEL, "p_name"), (v + "brand", "p_brand"), (v + "partType", "p_type"), (v + "size", "CAST(p_size AS VARCHAR)")], [])],
        "orders": [(f"'{b}order/' || o_orderkey", "Order", [(v + "orderPriority", "o_orderpriority"), (v + "orderStatus", "o_orderstatus")], [("placedBy", f"'{b}customer/' || o_custkey")])],
        "lineitem": [(f"'{b}lineitem/' || l_orderkey || '-' || l_linenumber", "LineItem", [(v + "returnFlag", "l_returnflag")], [("ofOrder", f"'{b}order/' || l_orderkey"), ("ofPart", f"'{b}part/' || l_partkey"), ("suppliedBy", f"'{b}supplier/' || l_suppkey")])],
    }
    out = []
    for table in tables:
        for s, kind, lits, objs in made[table]:
            out.append(f"SELECT {s} AS s, '{RDF_TYPE}' AS p, 'iri' AS k, '{v}{kind}' AS o FROM {table}")
            out += [f"SELECT {s}, '{p}', 'literal', {c} FROM {table}" for p, c in lits]
            out += [f"SELECT {s}, '{v}{p}', 'iri', {c} FROM {table}" for p, c in objs]
        if reverse and table == "orders":
            out.append(f"SELECT '{b}customer/' || o_custkey, '{v}placedOrder', 'iri', '{b}order/' || o_orderkey FROM orders")
    return "t AS (" + " UNION ALL ".join(out) + ")"


def _fragment(c: str) -> str:
    return f"CASE WHEN contains({c}, '#') THEN split_part({c}, '#', -1) WHEN contains({c}, '/') THEN split_part({c}, '/', -1) ELSE {c} END"


def _human(c: str) -> str:
    spaced = f"regexp_replace(translate({c}, '_-', '  '), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({spaced}, '\\s+', ' ', 'g'))"


def _fallback(c: str) -> str:
    return _human("(" + _fragment(c) + ")")


_LABELS = f"lit AS (SELECT s AS node, min(o) AS literal FROM t WHERE p = '{RDFS_LABEL}' AND k = 'literal' GROUP BY s)"

# -- scalar functions ------------------------------------------------------------


@query(f"WITH {_t(*SMALL, 'orders')} SELECT DISTINCT s AS iri, {_fragment('s')} AS fragment, {_fallback('s')} AS label FROM t")
def humanize_iri(spark, sf_dir):
    """Fragments and readable names of all subjects."""
    s = F.col("s")
    return table_triples(spark, sf_dir, (*SMALL, "orders")).select("s").distinct().select(s.alias("iri"), iri_fragment(s).alias("fragment"), fallback_label(s).alias("label"))


@query(f"SELECT p_partkey, {_human('p_name')} AS name, {_human('p_type')} AS kind, sha256(p_name) AS digest FROM part")
def humanize_names(spark, sf_dir):
    """Readable names and digests of parts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", humanize(F.col("p_name")).alias("name"), humanize(F.col("p_type")).alias("kind"), text_digest(F.col("p_name")).alias("digest"))


@query(f"WITH {_t('nation')} SELECT s, p, o, sha256(s || chr(9) || p || chr(9) || o) AS score FROM t")
def stable_scores(spark, sf_dir):
    """Scores that order objects."""
    return table_triples(spark, sf_dir, ("nation",)).select("s", "p", "o", stable_score(F.col("s"), F.col("p"), F.col("o")).alias("score"))


@query("SELECT s_suppkey, CAST(('0x' || substring(sha256(s_name), 1, 8))::UBIGINT % 256 AS BIGINT) AS shard FROM supplier")
def digest_shards(spark, sf_dir):
    """Shard of each supplier's digest."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", shard_of(text_digest(F.col("s_name")), 256).alias("shard"))


_NAMESPACE = "".join(f"\\x{POINT_NAMESPACE.replace('-', '')[i : i + 2]}" for i in range(0, 32, 2))


@query(f"""
WITH h AS (SELECT s_suppkey, sha1('{_NAMESPACE}'::BLOB || encode('tables' || chr(0) || '{BASE}supplier/' || s_suppkey || chr(0) || s_name)) AS h FROM supplier)
SELECT s_suppkey, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20], h[21:32]) AS id FROM h
""")
def point_ids(spark, sf_dir):
    """Stable ids of suppliers as points, UUIDv5 by its definition."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", point_id(F.lit("tables"), F.concat(F.lit(BASE + "supplier/"), F.col("s_suppkey").cast("string")), F.col("s_name")).alias("id"))


# -- scans and walks -------------------------------------------------------------


@query(f"WITH {_t(*SMALL)} SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Customer'")
def root_scan(spark, sf_dir):
    """Roots of a type."""
    return scan.root_iris(table_triples(spark, sf_dir, SMALL), V + "Customer")


@query(f"WITH {_t(*SMALL)}, r AS (SELECT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Nation') SELECT s, p, k AS o_kind, o FROM t SEMI JOIN r USING (s)")
def subject_scan(spark, sf_dir):
    """All triples of the nations."""
    t = table_triples(spark, sf_dir, SMALL)
    return scan.predicate_objects(t, scan.root_iris(t, V + "Nation")).select("s", "p", "o_kind", "o")


@query(f"WITH {_t(*SMALL)} SELECT s, string_agg(DISTINCT o, ' ' ORDER BY o) AS types FROM t WHERE p = '{RDF_TYPE}' GROUP BY s")
def node_types(spark, sf_dir):
    """Types of every node."""
    t = table_triples(spark, sf_dir, SMALL)
    return scan.types_of(t, t.select("s").distinct()).select("s", F.array_join("types", " ").alias("types"))


_WALK = GraphConfig(include_predicates=(V + "placedOrder", V + "inNation", V + "marketSegment"), ignore_predicates=(V + "marketSegment",), predicate_limit=3)
_W1 = f"r AS (SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Customer'), w AS (SELECT s, p, k, o, row_number() OVER (PARTITION BY s, p ORDER BY sha256(s || chr(9) || p || chr(9) || o)) AS n FROM t WHERE p IN ('{V}placedOrder', '{V}inNation'))"


@query(f"WITH {_t('customer', 'orders', reverse=True)}, {_W1} SELECT w.s, w.p, w.k AS o_kind, w.o FROM w SEMI JOIN r USING (s) WHERE n <= 3")
def walk_allow_ignore_limit(spark, sf_dir):
    """Edges of customers: an allowlist, a blocklist, three objects a predicate."""
    t = table_triples(spark, sf_dir, ("customer", "orders"), reverse=True)
    return walk.walk_one(t, scan.root_iris(t, V + "Customer"), _WALK).select("s", "p", "o_kind", "o")


_W2 = GraphConfig(include_predicates=(V + "inNation", V + "inRegion"), predicate_limit=2, expansion_limit=1)


@query(
    f"WITH {_t(*SMALL)}, r AS (SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Supplier'), e AS (SELECT s, p, o FROM t WHERE p IN ('{V}inNation', '{V}inRegion')) "
    "SELECT r.s AS root, 0 AS level, e.s, e.p, e.o FROM r JOIN e ON r.s = e.s UNION ALL SELECT r.s, 1, f.s, f.p, f.o FROM r JOIN e ON r.s = e.s JOIN e f ON f.s = e.o"
)
def walk_two_hop(spark, sf_dir):
    """Suppliers' nations and their regions."""
    t = table_triples(spark, sf_dir, SMALL)
    return walk.walk_paths(t, scan.root_iris(t, V + "Supplier"), _W2).select("root", "level", "s", "p", "o")


# -- labels ----------------------------------------------------------------------


@query(f"WITH {_t(*SMALL)} SELECT DISTINCT p, lower({_fallback('p')}) AS text FROM t")
def predicate_labels(spark, sf_dir):
    """Names of predicates."""
    t = table_triples(spark, sf_dir, SMALL)
    return labels.predicate_texts(t, t, GraphConfig())


@query(f"WITH {_t(*SMALL, 'orders')}, {_LABELS} SELECT DISTINCT t.s AS node, coalesce(literal, {_fallback('t.s')}) AS label FROM t LEFT JOIN lit ON lit.node = t.s")
def best_label(spark, sf_dir):
    """Labels of all subjects, by rdfs:label or IRI."""
    t = table_triples(spark, sf_dir, (*SMALL, "orders"))
    return labels.root_labels(t, t.select("s").distinct(), TargetConfig(type="")).select(F.col("s").alias("node"), "label")


_TEMPLATE = TargetConfig(type=V + "Customer", label_template="{seg}: {name} ({nation}) {none}", label_fields={"seg": V + "marketSegment", "name": RDFS_LABEL, "nation": V + "inNation"})


@query(f"SELECT '{BASE}customer/' || c_custkey AS s, c_mktsegment || ': ' || c_name || ' (' || n_name || ')' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def template_label(spark, sf_dir):
    """Customers labelled by a template of literals and a nation's label."""
    t = table_triples(spark, sf_dir, SMALL)
    return labels.root_labels(t, scan.root_iris(t, _TEMPLATE.type), _TEMPLATE)


_SETUP = Materialization.from_dict(
    {
        "defaults": {"predicate_limit": 3},
        "label_profiles": {"nation": {"type": V + "Nation", "template": "{name} / {region}", "fields": {"name": RDFS_LABEL, "region": V + "inRegion"}}, "supplier": {"type": V + "Supplier", "template": "{name} of {nation}", "fields": {"name": RDFS_LABEL, "nation": V + "inNation"}}},
        "targets": {"supplier": {"type": V + "Supplier", "expansion_limit": 0}, "customer": {"type": V + "Customer", "ignore_predicates": [RDF_TYPE, RDFS_LABEL]}},
    }
)


@query(f"SELECT '{BASE}supplier/' || s_suppkey AS s, s_name || ' of ' || n_name || ' / ' || r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def profile_label(spark, sf_dir):
    """Suppliers labelled by a profile over nations with a profile of their own."""
    t = written(table_triples(spark, sf_dir, SMALL), "triples")
    config = _SETUP.target("supplier")
    return labels.root_labels(t, scan.root_iris(t, config.type), config, _SETUP)


# -- documents -------------------------------------------------------------------

_DOC = TargetConfig(type=V + "Customer", include_predicates=(RDFS_LABEL, V + "inNation", V + "placedOrder", V + "marketSegment"), predicate_limit=3)


def _doc_sql(tables: tuple[str, ...], kind: str, predicates: tuple[str, ...], limit: int, reverse: bool = False) -> str:
    """CTEs up to docs(iri, label, embedding_text)."""
    inside = ", ".join(f"'{p}'" for p in predicates)
    return (
        f"{_t(*tables, reverse=reverse)}, {_LABELS}, r AS (SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}{kind}'), "
        f"w AS (SELECT t.s, p, k, o, sha256(t.s || chr(9) || p || chr(9) || o) AS rank FROM t SEMI JOIN r ON t.s = r.s WHERE p IN ({inside})), "
        "x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY rank) AS n FROM w) WHERE n <= " + str(limit) + "), "
        f"lines AS (SELECT s, p, rank, lower({_fallback('p')}) || ': ' || CASE WHEN k = 'literal' THEN o ELSE coalesce(literal, {_fallback('o')}) END AS line FROM x LEFT JOIN lit ON k = 'iri' AND lit.node = x.o), "
        "b AS (SELECT s, string_agg(line, chr(10) ORDER BY p, rank, line) AS body FROM lines GROUP BY s), "
        f"h AS (SELECT r.s, coalesce(literal, {_fallback('r.s')}) AS label FROM r LEFT JOIN lit ON lit.node = r.s), "
        "docs AS (SELECT h.s AS iri, label, 'label: ' || label || coalesce(chr(10) || body, '') AS embedding_text FROM h LEFT JOIN b ON b.s = h.s)"
    )


@query("WITH " + _doc_sql((*SMALL, "orders"), "Customer", _DOC.include_predicates, 3, True) + " SELECT iri, label, embedding_text, sha256(embedding_text) AS digest FROM docs")
def textify_documents(spark, sf_dir):
    """One text for every customer."""
    t = written(table_triples(spark, sf_dir, (*SMALL, "orders"), reverse=True), "triples")
    return textify.documents(t, _DOC).select("iri", "label", "embedding_text", "digest")


_PART = TargetConfig(type=V + "Part", label_predicates=(V + "partType",), include_rdfs_label=False, include_predicates=(RDFS_LABEL, V + "partType"), predicate_limit=5)


@query(
    "WITH d AS (SELECT '" + BASE + "part/' || p_partkey AS iri, p_type AS label, 'label: ' || p_type || chr(10) || 'part type: ' || p_type || chr(10) || 'label: ' || p_name AS embedding_text FROM part), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY embedding_text ORDER BY iri) AS i FROM d) "
    "SELECT embedding_text, min(label) AS label, count(*) AS iri_count, string_agg(iri, ' ' ORDER BY iri) FILTER (i <= 10) AS iris, sha256(embedding_text) AS digest FROM n GROUP BY embedding_text"
)
def textify_grouped(spark, sf_dir):
    """Parts with the same text as one record: its first ten IRIs and their number."""
    t = table_triples(spark, sf_dir, ("part",))
    found = textify.group_documents(textify.documents(t, _PART))
    return found.select("embedding_text", "label", "iri_count", F.array_join("iris", " ").alias("iris"), "digest")


@query()
def textify_targets(spark, sf_dir):
    """Records of two targets together, with profiles."""
    t = written(table_triples(spark, sf_dir, SMALL), "triples")
    return textify.textify(t, _SETUP).select("embedding_text", "label", "iri_count", F.array_join("iris", " ").alias("iris"), "digest")


@query(
    f"WITH {_t(*SMALL, 'orders', reverse=True)}, r AS (SELECT DISTINCT s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Customer'), {_LABELS}, "
    f"w AS (SELECT t.s, p, k, o, sha256(t.s || chr(9) || p || chr(9) || o) AS score, count(*) OVER (PARTITION BY t.s, p) AS m FROM t SEMI JOIN r ON t.s = r.s WHERE p NOT IN ('{RDF_TYPE}', '{RDFS_LABEL}')), "
    "x AS (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY score) AS n FROM w), "
    f"lines AS (SELECT s, p, CASE WHEN m > 5 THEN score ELSE o END AS rank, lower({_fallback('p')}) || ': ' || CASE WHEN k = 'literal' THEN o ELSE coalesce(literal, {_fallback('o')}) END AS line FROM x LEFT JOIN lit ON k = 'iri' AND lit.node = x.o WHERE n <= 5), "
    "b AS (SELECT s, string_agg(line, chr(10) ORDER BY p, rank, line) AS body FROM lines GROUP BY s), "
    "d AS (SELECT r.s AS iri, 'entity: ' || literal || coalesce(chr(10) || body, '') AS embedding_text FROM r JOIN lit ON lit.node = r.s LEFT JOIN b ON b.s = r.s) "
    "SELECT min(iri) AS iri, embedding_text FROM d GROUP BY embedding_text"
)
def legacy_documents(spark, sf_dir):
    """The older rendering of customers, one IRI for each text."""
    t = written(table_triples(spark, sf_dir, (*SMALL, "orders"), reverse=True), "triples")
    docs = textify.legacy_documents(t, V + "Customer", (RDFS_LABEL,), (RDF_TYPE, RDFS_LABEL), V + "given", V + "family")
    return textify.legacy_distinct(docs)


# -- surveys of a graph ----------------------------------------------------------

_SAMPLE = (
    f"{_t(*SMALL, 'orders', reverse=True)}, ty AS (SELECT DISTINCT s, o AS type FROM t WHERE p = '{RDF_TYPE}'), "
    f"sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY sha256('{SEED}:' || s), s) AS n FROM ty) WHERE n <= 5), "
    "sz AS (SELECT type, count(*) AS sampled FROM sm GROUP BY type), "
    f"e AS (SELECT sm.type, t.s, t.p, t.k, t.o FROM t JOIN sm ON t.s = sm.s WHERE t.p <> '{RDF_TYPE}')"
)


def _sampled(spark, sf_dir):
    t = table_triples(spark, sf_dir, (*SMALL, "orders"), reverse=True)
    samples = sampling.type_samples(t, SEED)
    return t, samples, sampling.sampled_edges(t, samples)


@query(f"WITH {_t(*SMALL, 'orders')} SELECT o AS type, count(DISTINCT s) AS count FROM t WHERE p = '{RDF_TYPE}' GROUP BY o")
def type_counts(spark, sf_dir):
    """Subjects of each type."""
    return sampling.type_counts(table_triples(spark, sf_dir, (*SMALL, "orders")))


@query(f"WITH {_SAMPLE} SELECT type, s FROM sm")
def type_sample(spark, sf_dir):
    """Five uniformly drawn subjects of each type."""
    return _sampled(spark, sf_dir)[1].select("type", "s")


@query(
    f"WITH {_SAMPLE}, v AS (SELECT DISTINCT type, p, o FROM e WHERE k = 'literal'), vs AS (SELECT type, p, string_agg(o, '|' ORDER BY o) AS values FROM (SELECT *, row_number() OVER (PARTITION BY type, p ORDER BY o) AS n FROM v) WHERE n <= 3 GROUP BY type, p) "
    "SELECT e.type, e.p AS predicate, count(*) AS count, round(count(*) / any_value(sampled), 6) AS mean_per_subject, any_value(values) AS values FROM e JOIN sz ON sz.type = e.type JOIN vs ON vs.type = e.type AND vs.p = e.p WHERE k = 'literal' GROUP BY e.type, e.p"
)
def literal_predicate_stats(spark, sf_dir):
    """Literals of sampled subjects by predicate."""
    _, samples, edges = _sampled(spark, sf_dir)
    return sampling.literal_predicates(edges, samples).select("type", "predicate", "count", F.round("mean_per_subject", 6).alias("mean_per_subject"), F.array_join("values", "|").alias("values"))


@query(f"WITH {_SAMPLE} SELECT e.type, p AS predicate, count(*) AS count, round(count(*) / any_value(sampled), 6) AS mean_per_subject FROM e JOIN sz ON sz.type = e.type WHERE k = 'iri' GROUP BY e.type, p")
def object_predicate_stats(spark, sf_dir):
    """Objects of sampled subjects by predicate."""
    _, samples, edges = _sampled(spark, sf_dir)
    return sampling.object_predicates(edges, samples).withColumn("mean_per_subject", F.round("mean_per_subject", 6))


@query(f"WITH {_SAMPLE} SELECT e.type, e.p AS predicate, ty.type AS object_type, count(*) AS count FROM e JOIN ty ON ty.s = e.o WHERE k = 'iri' GROUP BY ALL")
def object_type_stats(spark, sf_dir):
    """Types of sampled subjects' objects."""
    t, _, edges = _sampled(spark, sf_dir)
    return sampling.object_types(t, edges)


@query(f"WITH {_SAMPLE} SELECT e.type, e.p AS predicate, t.p AS label_predicate, count(*) AS count FROM e JOIN t ON t.s = e.o AND t.k = 'literal' WHERE e.k = 'iri' GROUP BY ALL")
def object_label_stats(spark, sf_dir):
    """Literals of sampled subjects' objects by predicate."""
    t, _, edges = _sampled(spark, sf_dir)
    return sampling.object_label_predicates(t, edges).drop("values")


@query(f"WITH {_SAMPLE}, {_LABELS}, o AS (SELECT DISTINCT type, p AS predicate, o AS iri FROM e WHERE k = 'iri') SELECT type, predicate, iri, coalesce(literal, {_fallback('iri')}) AS label FROM (SELECT *, row_number() OVER (PARTITION BY type, predicate ORDER BY iri) AS n FROM o) LEFT JOIN lit ON node = iri WHERE n <= 5")
def object_samples(spark, sf_dir):
    """Objects of sampled subjects with labels."""
    t, _, edges = _sampled(spark, sf_dir)
    return sampling.sample_objects(t, edges).select("type", "predicate", "iri", "label")


@query()
def nested_type_samples(spark, sf_dir):
    """The whole survey, one nested row a type, as JSON."""
    t = table_triples(spark, sf_dir, (*SMALL, "orders"), reverse=True)
    return sampling.sample_types(t, seed=SEED).select("type", F.to_json(F.struct("*")).alias("survey"))


@query(f"WITH {_t(*SMALL)}, x AS (SELECT DISTINCT 'customers' AS target, s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Customer' UNION ALL SELECT DISTINCT 'nations', s FROM t WHERE p = '{RDF_TYPE}' AND o = '{V}Nation') SELECT target, s FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sha256('{SEED}:' || s), s) AS n FROM x) WHERE n <= 7")
def target_sample(spark, sf_dir):
    """Seven uniformly drawn roots of each target."""
    t = table_triples(spark, sf_dir, SMALL)
    return sampling.sample_target_roots(t, {"customers": V + "Customer", "nations": V + "Nation"}, 7, SEED).select("target", "s")


@query(
    f"WITH {_t(*SMALL)}, c AS (SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT k || o) AS objects FROM t) "
    "SELECT *, substring(sha256(triples || '|' || subjects || '|' || predicates || '|' || objects), 1, 16) AS seed FROM c"
)
def graph_identity(spark, sf_dir):
    """Counts of a graph and its seed."""
    return sampling.graph_seed(table_triples(spark, sf_dir, SMALL))


# -- search ----------------------------------------------------------------------


@query(_knn_sql("true", 10))
def knn_topk(spark, sf_dir):
    """The ten nearest points of point 0, itself among them."""
    return _hits(search.top_k(_points(spark, sf_dir), _vector(spark, sf_dir, 0), 10))


@query(_knn_sql("graph IN ('1', '3')", 10))
def knn_include(spark, sf_dir):
    """The nearest in two graphs."""
    return _hits(search.search(_points(spark, sf_dir), search.Query(node="vec/0", include_graphs=("1", "3"))))


@query(_knn_sql("graph IS NULL OR graph NOT IN ('1', '3')", 10))
def knn_exclude(spark, sf_dir):
    """The nearest outside two graphs."""
    return _hits(search.search(_points(spark, sf_dir), search.Query(node="vec/0", exclude_graphs=("1", "3"))))


@query(_knn_sql("true", 10, 20))
def knn_offset(spark, sf_dir):
    """The third page of ten."""
    return _hits(search.search(_points(spark, sf_dir), search.Query(node="vec/0", limit=10, offset=20)))


@query(_knn_sql("true", 5, 0, 7))
def node_similar(spark, sf_dir):
    """Points similar to another one."""
    return _hits(search.search(_points(spark, sf_dir), search.build_query("node", "vec/7", [], None, "5")))


@query(f"WITH {_P.format(3)} SELECT graph, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY s.score DESC, id) AS rank FROM s) t WHERE rank <= 5")
def survey_topk_per_graph(spark, sf_dir):
    """The five nearest in each graph."""
    found = search.top_k_per_graph(_points(spark, sf_dir), _vector(spark, sf_dir, 3), 5)
    return found.select("graph", "rank", "id", F.round("score", 6).alias("score"))


@query(
    f"WITH {_P.format(3)}, g AS (SELECT * FROM (VALUES (0, '4'), (1, 'none'), (2, '2')) v(ord, graph)), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY s.score DESC, id) AS rank FROM s) t WHERE rank <= 3) "
    "SELECT ord, graph, rank, id, round(score, 6) AS score FROM g LEFT JOIN h USING (graph)"
)
def survey_graphs(spark, sf_dir):
    """A survey of given graphs, one of which is unknown."""
    found = search.survey(_points(spark, sf_dir), search.resolve_graphs([], ["4", "none", "2"]), _vector(spark, sf_dir, 3), 3)
    return found.select("ord", "graph", "rank", "id", F.round("score", 6).alias("score"))


@query("SELECT CAST(label AS VARCHAR) AS graph, count(*) AS count FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def graph_facets(spark, sf_dir):
    """Points of each graph."""
    return search.facets(_points(spark, sf_dir))


@query(f"WITH {_P.format(0)} SELECT id, round(score, 6) AS score, 'vec/' || id AS primary_uri, 1::BIGINT AS iri_count, 'vec/' || id AS label, graph, '' AS repr, 'vec%2F' || id AS encoded_uri FROM (SELECT * FROM s ORDER BY s.score DESC, id LIMIT 10) t")
def result_rows(spark, sf_dir):
    """Hits as an API shows them."""
    found = search.api_rows(search.top_k(_points(spark, sf_dir), _vector(spark, sf_dir, 0), 10))
    return found.withColumn("score", F.round("score", 6)).drop("iris")


@query("SELECT id, graph FROM (SELECT vec_id AS id, CAST(label AS VARCHAR) AS graph, row_number() OVER (PARTITION BY label ORDER BY sha256('0:' || vec_id), vec_id) AS n FROM embeddings) WHERE n <= 20")
def point_sample(spark, sf_dir):
    """Twenty uniformly drawn points of each graph."""
    return search.sample_points(_points(spark, sf_dir), 20).select("id", "graph")


@query()
def approximate_knn(spark, sf_dir):
    """The ten nearest by locality-sensitive hashing."""
    return _hits(search.approximate_top_k(_points(spark, sf_dir), _vector(spark, sf_dir, 0), 10))


# -- retrieval quality -----------------------------------------------------------

_EVAL_SQL = (
    "qs AS (SELECT vec_id AS qid, label AS qg, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id < 20), "
    "p AS (SELECT vec_id AS id, label AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "s AS (SELECT qid, qg, id, g, round(list_cosine_similarity(v, qv), 9) AS score FROM p, qs), "
    "m AS (SELECT qid, qg, id, score, 'knn' AS mode FROM s WHERE g = qg UNION ALL SELECT qid, qg, id, score, 'in_graph' FROM s WHERE g = qg AND id % 5 <> 0 UNION ALL SELECT qid, qg, id, score, 'all_graph' FROM s WHERE id % 3 <> 0), "
    "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 50)"
)


def _evaluation(spark, sf_dir) -> DataFrame:
    """Hits of 20 queries: exact, and two stand-ins for searches, which miss every fifth and third point, as SQL can express."""
    from pyspark.sql import Window

    from ..functions.vectors import as_doubles, cosine

    p = _points(spark, sf_dir)
    q = p.where("id < 20").select(F.col("id").alias("query_id"), F.col("graph").alias("target_graph"), as_doubles(F.col("vector")).alias("qv"))
    both = p.crossJoin(F.broadcast(q)).select("query_id", "target_graph", "id", "graph", F.round(cosine(as_doubles(F.col("vector")), F.col("qv")), 9).alias("score"))
    same = F.col("graph") == F.col("target_graph")
    modes = F.array(F.when(same, "knn"), F.when(same & (F.col("id") % 5 != 0), "in_graph"), F.when(F.col("id") % 3 != 0, "all_graph"))
    rows = both.withColumn("mode", F.explode(F.filter(modes, lambda m: m.isNotNull())))
    rank = F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= 50).drop("graph")


@query(
    f"WITH {_EVAL_SQL}, k AS (SELECT unnest([1, 5, 10, 20, 50]) AS k), a AS (SELECT k, qid, id FROM h, k WHERE mode = 'knn' AND rank <= k), n AS (SELECT k, qid, count(*) AS size FROM a GROUP BY ALL), "
    "b AS (SELECT k, qid, mode, id FROM h, k WHERE mode <> 'knn' AND rank <= k), md AS (SELECT DISTINCT qid, mode FROM h WHERE mode <> 'knn'), o AS (SELECT b.k, b.qid, mode, count(*) AS overlap FROM b JOIN a ON a.k = b.k AND a.qid = b.qid AND a.id = b.id GROUP BY ALL) "
    "SELECT n.qid AS query_id, md.mode, CAST(n.k AS INTEGER) AS k, coalesce(overlap, 0) AS overlap, round(coalesce(overlap, 0) / size, 6) AS recall FROM n JOIN md ON md.qid = n.qid LEFT JOIN o ON o.k = n.k AND o.qid = n.qid AND o.mode = md.mode"
)
def recall_at_k(spark, sf_dir):
    """Recall of two searches at five depths."""
    return evaluate.recall_table(_evaluation(spark, sf_dir)).select("query_id", "mode", "k", "overlap", F.round("recall", 6).alias("recall"))


@query(f"WITH {_EVAL_SQL}, w AS (SELECT qid, min(score) AS worst FROM h WHERE mode = 'all_graph' GROUP BY qid) SELECT h.qid AS query_id, h.id, h.rank, round(h.score, 6) AS score FROM h JOIN w ON w.qid = h.qid WHERE mode = 'knn' AND score > worst AND NOT EXISTS (SELECT 1 FROM h a WHERE a.mode = 'all_graph' AND a.qid = h.qid AND a.id = h.id)")
def missed_points(spark, sf_dir):
    """Exact hits that the search over all graphs missed."""
    return evaluate.missed_points(_evaluation(spark, sf_dir)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_EVAL_SQL} SELECT qid AS query_id, mode, round(min(score), 6) AS low, round(max(score), 6) AS high FROM h GROUP BY ALL")
def score_range(spark, sf_dir):
    """Scores of each search."""
    return evaluate.score_ranges(_evaluation(spark, sf_dir)).select("query_id", "mode", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _searches(spark, sf_dir) -> DataFrame:
    """Hits of every fiftieth point: exact, and of the locality-sensitive search in its graph and over all."""
    return evaluate.run_all(_points(spark, sf_dir), F.col("id") % 50 == 0)


@query()
def recall_summary(spark, sf_dir):
    """Mean recall of the locality-sensitive search by graph and depth."""
    return evaluate.summary(_searches(spark, sf_dir), by_graph=True)


@query()
def search_recall_at_k(spark, sf_dir):
    """Recall of the locality-sensitive search at five depths."""
    return evaluate.recall_table(_searches(spark, sf_dir)).select("query_id", "mode", "k", "overlap", F.round("recall", 6).alias("recall"))


@query()
def search_missed_points(spark, sf_dir):
    """Mean and greatest number of exact hits that the locality-sensitive search over all graphs missed."""
    return evaluate.missed_summary(_searches(spark, sf_dir))


@query()
def search_score_range(spark, sf_dir):
    """Scores of the exact and the locality-sensitive search."""
    return evaluate.score_ranges(_searches(spark, sf_dir)).select("query_id", "mode", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))

