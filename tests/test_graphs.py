import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, RDFS_LABEL, TRIPLES
from graphloom.operators import labels, sampling, scan, textify, walk
from graphloom.operators.config import GraphConfig, Materialization, TargetConfig
from graphloom.sources import triples as T

E = "http://example.com/"


def graph(spark, *rows):
    """Triples from (s, p, o): an o that starts with a quote is a literal, a name with _: a blank node."""

    def full(x):
        return x if x.startswith(("http", "_:")) else E + x

    made = []
    for s, p, o in rows:
        kind = "literal" if o.startswith('"') else "bnode" if o.startswith("_:") else "iri"
        lang = o.rsplit("@", 1)[1] if kind == "literal" and "@" in o else None
        made.append(("g", "bnode" if s.startswith("_:") else "iri", full(s), full(p), kind, o.rsplit('"', 1)[0][1:] if kind == "literal" else full(o), lang, None))
    return spark.createDataFrame(made, TRIPLES)


def texts(docs):
    return {r.iri: r.embedding_text for r in docs.collect()}


def embedding_graph(spark):
    return graph(
        spark, ("root", RDF_TYPE, "Thing"), ("root", RDFS_LABEL, '"Root label"'), ("root", "hasRelatedThing", "relatedThing"), ("root", "has-score", '"42"'), ("root", "blank", "_:b"),
        ("_:b", "nestedName", '"Nested literal"'), ("hasRelatedThing", RDFS_LABEL, '"related predicate"'), ("relatedThing", RDFS_LABEL, '"Related label"'), ("relatedThing", RDF_TYPE, "Related"),
    )


def test_document_text(spark):
    got = texts(textify.documents(embedding_graph(spark), TargetConfig(type=E + "Thing")))
    assert got == {E + "root": "label: Root label\nhas score: 42\nrelated predicate: Related label\ntype: Thing\nlabel: Root label"}


def test_template_and_profile(spark):
    g = embedding_graph(spark)
    config = TargetConfig(type=E + "Thing", label_template="{name}: {score}", label_fields={"name": RDFS_LABEL, "score": E + "has-score"})
    assert [r.label for r in labels.root_labels(g, scan.root_iris(g, E + "Thing"), config).collect()] == ["Root label: 42"]
    setup = Materialization.from_dict({"label_profiles": {"r": {"type": E + "Related", "template": "profile: {name}", "fields": {"name": RDFS_LABEL}}}, "targets": {"t": {"type": E + "Thing"}}})
    assert "related predicate: profile: Related label" in texts(textify.documents(g, setup.target("t"), setup))[E + "root"]


def test_a_profile_of_the_type_beats_the_target_template(spark):
    g = graph(spark, ("a", RDF_TYPE, "T"), ("a", RDFS_LABEL, '"n"'))
    setup = Materialization.from_dict({"label_profiles": {"p": {"type": E + "T", "template": "P {n}", "fields": {"n": RDFS_LABEL}}}, "targets": {"t": {"type": E + "T", "label_template": "own", "label_fields": {}}}})
    assert [r.label for r in textify.documents(g, setup.target("t"), setup).collect()] == ["P n"]


def walk_graph(spark):
    return graph(spark, *[("root", "hasPart", f"object{x}") for x in "ABC"], ("root", "ignored", '"skip me"'), *[(f"object{x}", "leaf", "nested") for x in "ABC"])


def test_walk_limit_is_by_score(spark):
    config = GraphConfig(ignore_predicates=(E + "ignored",), predicate_limit=2, expansion_limit=1)
    root = spark.createDataFrame([(E + "root",)], "s string")
    rows = walk.walk_paths(walk_graph(spark), root, config).orderBy("root", "path").collect()
    order = sorted((E + "object" + x for x in "ABC"), key=lambda o: hashlib.sha256(f"{E}root\t{E}hasPart\t{o}".encode()).hexdigest())[:2]
    assert [r.o for r in rows if r.level == 0] == order
    assert [(r.level, r.p) for r in rows] == [(0, E + "hasPart"), (1, E + "leaf")] * 2


@pytest.mark.parametrize(("include", "ignore", "left"), [((E + "ignored",), (), {"ignored"}), ((E + "ignored", E + "hasPart"), (E + "hasPart",), {"ignored"}), ((), (), {"hasPart", "ignored"})])
def test_allow_and_ignore(spark, include, ignore, left):
    root = spark.createDataFrame([(E + "root",)], "s string")
    rows = walk.walk_one(walk_graph(spark), root, GraphConfig(include_predicates=include, ignore_predicates=ignore)).collect()
    assert {r.p.removeprefix(E) for r in rows} == left


def test_grouping_and_cap(spark):
    g = graph(spark, *[(x, RDF_TYPE, "Thing") for x in "abc"], *[(x, "name", '"Diabetes"') for x in "ab"], ("c", "name", '"Other"'))
    docs = textify.documents(g, TargetConfig(type=E + "Thing", label_predicates=(E + "name",)))
    got = {r.label: (r.iris, r.iri_count) for r in textify.group_documents(docs, cap=1).collect()}
    assert got == {"Diabetes": ([E + "a"], 2), "Other": ([E + "c"], 1)}
    assert [r.label for r in textify.truncated(textify.group_documents(docs, cap=1), 1).collect()] == ["Diabetes"]
    assert textify.group_documents(docs).where("label = 'Diabetes'").first().embedding_text == "label: Diabetes\nname: Diabetes\ntype: Thing"
    shuffled = textify.group_documents(docs.repartition(3).unionByName(docs), cap=5)
    assert {r.label: r.iri_count for r in shuffled.collect()} == {"Diabetes": 2, "Other": 1}


def test_label_edge_cases(spark):
    g = graph(spark, ("someThing", "first", '""'), ("someThing", "second", '"x"'), ("http://e/x/", "second", '""'), ("b", RDF_TYPE, "T"), ("b", "p", '"x"@en'), ("b", "p", '"x"@fr'))
    roots = spark.createDataFrame([(E + "someThing",), ("http://e/x/",)], "s string")
    config = TargetConfig(type="", label_predicates=(E + "first", E + "second"))
    assert {r.s: r.label for r in labels.root_labels(g, roots, config).collect()} == {E + "someThing": "some Thing", "http://e/x/": "http://e/x/"}
    assert texts(textify.documents(g, TargetConfig(type=E + "T")))[E + "b"].count("p: x") == 2


def test_blank_objects_count_for_the_limit(spark):
    objects = ["_:b1", E + "o1", E + "o2"]
    least = min(objects, key=lambda o: hashlib.sha256(f"{E}r\t{E}p\t{o}".encode()).hexdigest())
    g = graph(spark, ("r", RDF_TYPE, "T"), *[("r", "p", o) for o in objects])
    got = texts(textify.documents(g, TargetConfig(type=E + "T", predicate_limit=1, ignore_predicates=(RDF_TYPE,))))[E + "r"]
    assert got == ("label: r" if least.startswith("_:") else f"label: r\np: {least.rsplit('/', 1)[1]}")


def test_targets_merge(spark):
    g = graph(spark, ("a", RDF_TYPE, "A"), ("b", RDF_TYPE, "B"), ("a", "v", '"x"'), ("b", "v", '"x"'))
    setup = Materialization.from_dict({"defaults": {"include_predicates": [E + "v"], "label_predicates": [E + "v"]}, "targets": {"a": {"type": E + "A"}, "b": {"type": E + "B"}}})
    assert [(r.iris, r.iri_count) for r in textify.textify(g, setup).collect()] == [([E + "a", E + "b"], 2)]


def test_ntriples(spark):
    lines = ['<http://e/s> <http://e/p> "a\\"b\\n\\u00e9 \\U0001F600"@en .', "# note", "", '_:x <http://e/p> <http://e/o> .', '<http://e/s> <http://e/p> "1"^^<http://e/int> . # end', '<http://e/s> <http://e/p> "1"^^<http://e/int> .']
    rows = T.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"), F.lit("g")).collect()
    got = {(r.s_kind, r.s, r.o_kind, r.o, r.o_lang, r.o_datatype) for r in rows}
    assert got == {("iri", "http://e/s", "literal", 'a"b\né 😀', "en", None), ("bnode", "_:x", "iri", "http://e/o", None, None), ("iri", "http://e/s", "literal", "1", None, "http://e/int")}
    assert len(rows) == 3
    with pytest.raises(Exception, match="not an N-Triples line"):
        T.parse_ntriples(spark.createDataFrame([("nonsense",)], "value string")).collect()
    with pytest.raises(ValueError):
        T.guess_format("x.csv")
    assert T.guess_format("A.TTL") == "turtle"


def test_samples_are_uniform_and_repeatable(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) as draw").crossJoin(spark.range(10).selectExpr("cast(id as string) as s"))
    drawn = rows.withColumn("key", F.concat_ws("/", "draw", "s"))
    share = sampling.sample_by(drawn, "draw", "key", 2, "seed").groupBy("s").count().collect()
    assert len(share) == 10 and all(0.15 < r["count"] / 4000 < 0.25 for r in share)
    g = graph(spark, *[(f"t{i:02}", RDF_TYPE, "T") for i in range(60)])
    one, two, three = ([r.s for r in sampling.type_samples(g.repartition(n), seed, 3).orderBy("s").collect()] for n, seed in ((1, "a"), (3, "a"), (1, "b")))
    assert one == two and one != three


def test_type_survey(spark):
    g = graph(
        spark, *[(f"treat{x}", RDF_TYPE, "Treatment") for x in "AB"], *[(f"proj{x}", RDF_TYPE, "Project") for x in "AB"], *[(f"treat{x}", "name", f'"Treatment {x}"') for x in "AB"],
        *[(f"treat{x}", "linksTo", f"proj{x}") for x in "AB"], *[(f"proj{x}", RDFS_LABEL, f'"project {x}"') for x in "AB"],
    )
    row = sampling.sample_types(g, limit=2, values=1, seed="s").where(F.col("type") == E + "Treatment").first()
    assert (row.label, row["count"], sorted(row.sample_iris)) == ("Treatment", 2, [E + "treatA", E + "treatB"])
    assert [(p.label, p["count"], p.mean_per_subject, p["values"]) for p in row.literal_predicates] == [("name", 2, 1.0, ["Treatment A"])]
    link = row.object_predicates[0]
    assert (link.label, link["count"], link.object_types[0].label, link.object_types[0]["count"], link.sample_objects[0].label) == ("links to", 2, "Project", 2, "project A")


def test_legacy_keeps_one_iri_per_text(spark):
    g = graph(spark, *[(x, RDF_TYPE, "P") for x in "ab"], *[(x, "given", '"Ada"') for x in "ab"], *[(x, "family", '"L"') for x in "ab"], *[("a", "knows", f"k{i}") for i in range(7)], *[("b", "knows", f"k{i}") for i in range(7)])
    docs = textify.legacy_documents(g, E + "P", (), (RDF_TYPE,), E + "given", E + "family")
    got = texts(docs)
    assert all(t.startswith("entity: Ada L\n") and t.count("knows:") == 5 for t in got.values())
    assert textify.legacy_distinct(docs.withColumn("embedding_text", F.lit("x"))).first().iri == E + "a"


def test_profiles_settle_over_long_chains(spark):
    links = [(f"n{i}", "next", f"n{i + 1}") for i in range(6)]
    setup = {"label_profiles": {"p": {"type": E + "T", "template": "{name}{next}", "fields": {"name": RDFS_LABEL, "next": E + "next"}}}, "targets": {"t": {"type": E + "T"}}}
    profiles = list(Materialization.from_dict(setup).label_profiles.values())
    rows = [(f"n{i}", RDF_TYPE, "T") for i in range(7)] + [(f"n{i}", RDFS_LABEL, f'"{i}"') for i in range(7)]
    found = labels.node_labels(graph(spark, *rows, *links), GraphConfig(), profiles)
    assert {r.node: r.label for r in found.collect()} == {f"{E}n{i}": "0123456"[i:] for i in range(7)}
    with pytest.raises(ValueError, match="have not settled"):
        labels.node_labels(graph(spark, *rows, *links, ("n6", "next", "n0")), GraphConfig(), profiles, rounds=3)


TURTLE = '''@prefix ex: <http://e/> . @base <http://b/x> . # note
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
ex:s a ex:T ; rdfs:label "a\\"b\\u00e9"@en-GB, """long "quoted"
text""", 'one' ; ex:n 1, -2.5, 3e4, true ; ex:to <y>, _:x, [ ex:in "v"^^ex:dt ; ] ; ex:all ( 1 ex:b ) ; .
ex:a.b ex:p ex:c\\,d.
[] ex:p ex:e .'''


def loaded(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return T.load_triples(spark, str(tmp_path / name)).collect()


def test_turtle(spark, tmp_path):
    rows = loaded(spark, tmp_path, "g.ttl", TURTLE)
    assert {r.graph for r in rows} == {"g"}
    of_s = {(r.p.rsplit("/", 1)[1], r.o_kind, r.o, r.o_lang, r.o_datatype) for r in rows if r.s == "http://e/s" and r.o_kind != "bnode"}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert of_s == {
        ("22-rdf-syntax-ns#type", "iri", "http://e/T", None, None), ("rdf-schema#label", "literal", 'a"bé', "en-GB", None), ("rdf-schema#label", "literal", 'long "quoted"\ntext', None, None), ("rdf-schema#label", "literal", "one", None, None),
        ("n", "literal", "1", None, xsd + "integer"), ("n", "literal", "-2.5", None, xsd + "decimal"), ("n", "literal", "3e4", None, xsd + "double"), ("n", "literal", "true", None, xsd + "boolean"), ("to", "iri", "http://b/y", None, None),
    }
    assert {(r.s, r.o) for r in rows if r.p == "http://e/p" and r.s_kind == "iri"} == {("http://e/a.b", "http://e/c,d")}
    inner = [r for r in rows if r.p == "http://e/in"]
    assert [(r.o, r.o_datatype) for r in inner] == [("v", "http://e/dt")] and inner[0].s in {r.o for r in rows if r.p == "http://e/to"}
    assert sorted(r.o for r in rows if r.p.endswith("#first")) == ["1", "http://e/b"]
    with pytest.raises(Exception, match="bad.ttl:2: cannot be read"):
        loaded(spark, tmp_path, "bad.ttl", "<http://e/a> <http://e/b>\n } .")
    assert loaded(spark, tmp_path, "none.ttl", "") == []


def test_trig_and_rdfxml(spark, tmp_path):
    rows = loaded(spark, tmp_path, "g.trig", "@prefix e: <http://e/> . e:s e:p 1 . e:g { e:s e:p 2 . [] e:p 3 } GRAPH <http://h> { e:s e:p 4 }")
    assert {(r.graph, r.o) for r in rows} == {(None, "1"), ("http://e/g", "2"), ("http://e/g", "3"), ("http://h", "4")}
    xml = f"""<rdf:RDF xmlns:rdf="{RDF_TYPE.removesuffix("type")}" xmlns:e="http://e/" xml:base="http://b/">
      <e:T rdf:about="s" e:short="v"><e:name xml:lang="fr">é</e:name><e:to rdf:resource="o"/><e:in><rdf:Description rdf:nodeID="x"/></e:in>
      <e:n rdf:datatype="http://e/int">5</e:n><e:r rdf:parseType="Resource"><e:deep>d</e:deep></e:r></e:T></rdf:RDF>"""
    rows = loaded(spark, tmp_path, "g.rdf", xml)
    got = {(r.s, r.p, r.o, r.o_lang, r.o_datatype) for r in rows if r.s == "http://b/s" and not r.p.endswith("/r")}
    s, e = "http://b/s", "http://e/"
    assert got == {(s, RDF_TYPE, e + "T", None, None), (s, e + "short", "v", None, None), (s, e + "name", "é", "fr", None), (s, e + "to", "http://b/o", None, None), (s, e + "in", "_:x", None, None), (s, e + "n", "5", None, "http://e/int")}
    assert [r.s for r in rows if r.p == e + "deep"] == [r.o for r in rows if r.p == e + "r"]
