import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.vectors import cosine
from graphloom.operators.config import Materialization


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_humanize(spark):
    given = ["camelCaseName", "snake_case-name", "  two  　 spaces ", "ABCDef", "éÉ", "", "x1Y"]
    assert column(spark, given, X.humanize) == ["camel Case Name", "snake case name", "two spaces", "ABCDef", "é É", "", "x1Y"]


def test_iri_fragment_and_fallback(spark):
    given = ["http://e/x#hasName", "http://e/a/has_name", "plain", "http://e/x/", "http://e/x#"]
    assert column(spark, given, X.iri_fragment) == ["hasName", "has_name", "plain", "", ""]
    assert column(spark, given, X.fallback_label) == ["has Name", "has name", "plain", "", ""]


def test_point_id_is_uuid5(spark):
    texts = ["", "a", "é漢", "line\nline"]
    got = column(spark, texts, lambda x: X.point_id(F.lit("g"), F.lit("http://e/1"), x))
    assert got == [str(uuid.uuid5(uuid.UUID(X.POINT_NAMESPACE), f"g\0http://e/1\0{t}")) for t in texts]


def test_percent_encode(spark):
    from urllib.parse import quote

    given = ["http://e/a b+c*d~é", "%"]
    assert column(spark, given, X.percent_encode) == [quote(x, safe="") for x in given]


def test_file_stem(spark):
    assert column(spark, ["/a/b/c.x.jsonl", "c", "/a/.hidden"], X.file_stem) == ["c.x", "c", ".hidden"]


def test_template(spark):
    row = spark.range(1).select(
        X.render_template("{id}: {name}", {}).alias("a"), X.render_template("{ x } {y}", {"x": F.lit("1"), "y": F.lit(None).cast("string")}).alias("b"), X.render_template("{x}", {}).alias("c")
    )
    assert tuple(row.first()) == (":", "1", None)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None


def test_config_merge(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[defaults]\nlabel_predicates=["a"]\npredicate_limit=3\ninclude_predicates=["p"]\n[label_profiles.x]\ntype="T"\ntemplate="{n}"\nfields={n="a"}\n[targets.t]\ntype="T"\nlabel_predicates=["a","b"]\nexpansion_limit=0\ninclude_predicates=["q"]\n')
    setup = Materialization.from_toml(path)
    target = setup.target("t")
    assert target.label_predicates == ("a", "b") and target.include_predicates == ("p", "q")
    assert (target.predicate_limit, target.expansion_limit, target.include_rdfs_label) == (3, 0, True)
    assert setup.profile_for("T").template == "{n}" and setup.profile_for("U") is None
    with pytest.raises(ValueError):
        setup.targets("none")
    with pytest.raises(ValueError):
        Materialization.from_dict({"targets": {"t": {"typ": "T"}}})


def test_explicit_none_overrides_a_default():
    setup = Materialization.from_dict({"defaults": {"predicate_limit": 3}, "targets": {"t": {"type": "T", "predicate_limit": None}}})
    assert setup.target("t").predicate_limit is None
