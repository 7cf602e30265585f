import json

import pytest

from graphloom.__main__ import main
from graphloom.operators import evaluate
from graphloom.sources import sinks

GRAPH = '''@prefix e: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
e:a a e:Drug ; rdfs:label "aspirin tablet" . e:b a e:Drug ; rdfs:label "iron supplement" . e:c a e:Drug ; rdfs:label "iron supplement" .'''


@pytest.fixture
def run(spark, capsys):
    def call(*args):
        capsys.readouterr()
        status = main([str(x) for x in args], spark)
        out = capsys.readouterr()
        return status, out.out, out.err

    return call


def test_from_graph_to_search(run, tmp_path):
    (tmp_path / "drugs.ttl").write_text(GRAPH)
    (tmp_path / "config.toml").write_text('[targets.drug]\ntype = "http://e/Drug"\n')
    records, points = tmp_path / "drugs.jsonl", tmp_path / "points"
    assert run("textify", tmp_path / "drugs.ttl", tmp_path / "config.toml", records)[0] == 0
    rows = [json.loads(x) for f in sorted(records.glob("part-*")) for x in f.read_text().splitlines()]
    assert [(r["label"], r["iris"], r["iri_count"]) for r in rows] == [("aspirin tablet", ["http://e/a"], 1), ("iron supplement", ["http://e/b", "http://e/c"], 2)]
    status, _, err = run("upload", points, records)
    assert status == 1 and err.startswith("error: collection does not exist")
    status, out, _ = run("upload", points, records, "--create")
    assert status == 0 and out.splitlines()[-1] == "total: 2 points"
    assert run("graphs", points)[1] == "drugs\t2\n"
    found = json.loads(run("search", points, "--text", "iron supplement", "--limit", 1, "--json", "--repr")[1])
    assert [(h["label"], h["graph"], h["iri_count"], "repr" in h) for h in found] == [("iron supplement", "drugs", 2, True)]
    line = run("search", points, "--node", "http://e/b", "--limit", 1)[1]
    assert line == "1.0000  drugs  iron supplement  <http://e/b> (+1 more)\n"
    survey = json.loads(run("survey", points, "--text", "aspirin", "--include", "drugs", "--include", "none", "--json")[1])
    assert [(g["graph"], len(g["results"])) for g in survey] == [("drugs", 2), ("none", 0)]
    assert run("search", points, "--node", "http://e/nowhere")[2] == "error: URI not found: http://e/nowhere\n"
    assert run("search", points, "--text", "x", "--include", "a", "--exclude", "b")[0] == 1


def test_sample(run, tmp_path):
    (tmp_path / "drugs.ttl").write_text(GRAPH)
    assert run("sample", tmp_path / "drugs.ttl", tmp_path / "s.json", "--limit", 2)[0] == 0
    (found,) = json.loads((tmp_path / "s.json").read_text())
    assert (found["type"], found["count"], len(found["sample_iris"])) == ("http://e/Drug", 3, 2)
    assert run("sample", tmp_path / "drugs.hdt", tmp_path / "s.txt", "--format", "text")[2].startswith("error: hdt cannot be read here")


def test_sampled_targets(run, spark, tmp_path):
    (tmp_path / "drugs.ttl").write_text(GRAPH)
    (tmp_path / "config.toml").write_text('[targets.drug]\ntype = "http://e/Drug"\n[targets.none]\ntype = "http://e/None"\n')
    args = ("sample", tmp_path / "drugs.ttl")
    assert run(*args, tmp_path / "t.json", "--config", tmp_path / "config.toml", "--limit", 3)[0] == 0
    found = {r["target"]: r for r in json.loads((tmp_path / "t.json").read_text())}
    assert [(r["label"], r["iris"]) for r in found["drug"]["records"]] == [("aspirin tablet", ["http://e/a"]), ("iron supplement", ["http://e/b", "http://e/c"])]
    assert found["none"]["records"] == []
    assert run(*args, tmp_path / "t.txt", "--config", tmp_path / "config.toml", "--limit", 1, "--format", "text")[0] == 0
    text = (tmp_path / "t.txt").read_text()
    assert text.count("target: ") == 2 and text.count("  - http://e/") == 1


def test_kept_runs_and_older_text(spark, tmp_path):
    hits = spark.createDataFrame([("q", "g", "knn", 1, "a", 0.9), ("q", "g", "knn", 2, "b", 0.1)], evaluate.RUN)
    evaluate.write_run(hits, str(tmp_path / "run"))
    assert sorted(evaluate.read_run(spark, str(tmp_path / "run")).collect()) == sorted(hits.collect())
    points = spark.createDataFrame([("a", ["http://e/a"], "A", "g", "text")], "id string, iri array<string>, label string, graph string, repr string")
    assert [(r.rank, r.label, r.iri) for r in evaluate.top_rows(hits, points, 1).collect()] == [(1, "A", ["http://e/a"])]
    assert [r.label for r in evaluate.top_rows(hits, points, 2).orderBy("rank").collect()] == ["A", None]
    sinks.write_documents_text(spark.createDataFrame([("http://e/a", "x: 1")], "iri string, embedding_text string"), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["iri: http://e/a", "x: 1", "", "---"]
