import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.embedding import HashingEmbedder
from graphloom.operators import evaluate, search
from graphloom.sources import jsonl, points, sinks
from graphloom.streaming.ingest import stream_points

DIM = 8


def planted(spark, **graphs):
    rows = []
    for graph, cosines in graphs.items():
        for i, c in enumerate(cosines):
            v = [c, (1 - c * c) ** 0.5] + [0.0] * (DIM - 2)
            rows.append((f"{graph}-{i}", v, None if graph == "none" else graph, [f"http://e/{graph}/{i}"], f"L{i}", None, None))
    return spark.createDataFrame(rows, "id string, vector array<float>, graph string, iri array<string>, label string, repr string, iri_count long")


UNIT = [1.0] + [0.0] * (DIM - 1)


def test_survey_order(spark):
    p = planted(spark, g_high=[1.0, 0.9, 0.8], g_mid=[0.5], g_low=[0.2, 0.1])
    rows = search.survey(p, ["g_low", "g_high", "unknown", "g_mid", "g_mid"], UNIT, 2).collect()
    assert [r.graph for r in rows] == ["g_high", "g_high", "g_mid", "g_mid", "g_low", "g_low", "unknown"]
    assert rows[0].best == pytest.approx(1.0, abs=1e-3) and rows[-1].score is None
    assert search.resolve_graphs(["a", "b"], None, ["a"]) == ["b"] and search.resolve_graphs(["a"], ["z", "z"], ["z"]) == ["z", "z"]


def test_filters(spark):
    p = planted(spark, a=[0.3], b=[0.7], none=[0.9])
    assert [r.id for r in search.top_k(p, UNIT, 9).collect()] == ["none-0", "b-0", "a-0"]
    assert [r.id for r in search.search(p, search.Query(node="http://e/b/0", exclude_graphs=("b",))).collect()] == ["none-0", "a-0"]
    assert [r.id for r in search.search(p, search.Query(node="http://e/b/0", include_graphs=("b",))).collect()] == ["b-0"]
    assert [r.id for r in search.search(p, search.Query(node="http://e/a/0", limit=1, offset=1)).collect()] == ["b-0"]
    with pytest.raises(search.NotFoundError):
        search.search(p, search.Query(node="http://e/zzz"))


def test_query_validation():
    assert search.build_query("text", "x", [], [], "7", "2").limit == 7
    for bad in (lambda: search.build_query("image", "x"), lambda: search.build_query("text", "x", ["a"], ["b"]), lambda: search.Query(text="x", limit=0), lambda: search.Query()):
        with pytest.raises(ValueError):
            bad()
    assert search.error_status(search.NotFoundError("n"))[0] == 404 and search.error_status(ValueError("v"))[0] == 400 and search.error_status(RuntimeError("r"))[0] == 500


def test_results_and_facets(spark):
    p = planted(spark, a=[0.3, 0.4], b=[0.7])
    row = search.api_rows(search.top_k(p, UNIT, 1)).first()
    assert (row.primary_uri, row.iri_count, row.repr, row.encoded_uri) == ("http://e/b/0", 1, "", "http%3A%2F%2Fe%2Fb%2F0")
    assert {r.graph: r["count"] for r in search.facets(p).collect()} == {"a": 2, "b": 1}
    assert [r.graph for r in search.facets(p, 1).collect()] == ["a"]
    assert {r.graph: r["count"] for r in search.sample_points(p, 1).groupBy("graph").count().collect()} == {"a": 1, "b": 1}


def test_approximate_search(spark):
    p = planted(spark, a=[i / 100 for i in range(100)])
    got = {r.id for r in search.approximate_top_k(p, UNIT, 10).collect()}
    assert len(got & {f"a-{i}" for i in range(90, 100)}) >= 8


def test_jsonl(spark, tmp_path):
    f = tmp_path / "g.jsonl"
    f.write_text('{"iris": ["http://e/1"], "label": "é", "embedding_text": "t", "more": 1}\n\n  \n{"iri": "http://e/2", "embedding_text": "u"}\n')
    rows = jsonl.read_jsonl(spark, str(f)).orderBy("line").collect()
    assert [(r.line, r.label, r.iris, r.iri) for r in rows] == [(1, "é", ["http://e/1"], None), (4, None, None, "http://e/2")]
    assert rows[0].extra == {"more": "1"}
    assert jsonl.read_jsonl(spark, str(f), limit=2).count() == 1 and jsonl.count_jsonl(spark, str(f)) == 2
    f.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match=r"g\.jsonl:2: invalid JSON"):
        jsonl.read_jsonl(spark, str(f)).collect()
    f.write_text('{"a": 1}\n{"a": 2}\n[1]\n')
    with pytest.raises(Exception, match=r"g\.jsonl:3: expected a JSON object"):
        jsonl.read_jsonl(spark, str(f)).collect()


def records(spark, texts):
    rows = [([f"http://e/{i}"], None, f"l{i}", t, None, 1, {}) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "iris array<string>, iri string, label string, embedding_text string, repr string, iri_count long, extra map<string,string>")


def test_upsert(spark, tmp_path):
    path, embedder = str(tmp_path / "points"), HashingEmbedder(64)
    with pytest.raises(ValueError):
        points.ensure_collection(spark, path)
    points.upsert(points.to_points(records(spark, list("abcde")), "one", embedder), path)
    points.upsert(points.to_points(records(spark, list("xy")), "two", embedder), path)
    points.upsert(points.to_points(records(spark, list("abcde")), "one", embedder), path)
    got = points.read_points(spark, path)
    assert {r.graph: r["count"] for r in got.groupBy("graph").count().collect()} == {"one": 5, "two": 2}
    assert got.select("id").distinct().count() == 7 and len(got.first().vector) == 64
    assert points.iri_index(got).where("iri = 'http://e/0'").count() == 2
    hit = search.search(got, search.Query(text="c"), embedder).first()
    assert hit.repr == "c" and hit.score == pytest.approx(1.0)
    with pytest.raises(Exception, match="missing non-empty embedding_text"):
        points.to_points(records(spark, [""]), "one", embedder).collect()


def test_upsert_without_graph_dimension_and_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "p")
    p = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None), ("c", [1.0, 1.0], "g")], "id string, vector array<float>, graph string")
    whole = [F.array(F.lit("i")).alias("iri"), *(F.lit(None).cast("string").alias(c) for c in ("label", "repr")), F.lit(1).cast("long").alias("iri_count"), F.create_map().cast("map<string,string>").alias("extra")]
    rows = p.select("id", "vector", *whole, "graph")
    points.upsert(rows, path)
    points.upsert(rows.where("id = 'b'").withColumn("label", F.lit("new")), path)
    assert {(r.id, r.label) for r in points.read_points(spark, path).collect()} == {("a", None), ("b", "new"), ("c", None)}
    two = rows.where("id = 'a'").withColumn("label", F.lit("one")).unionByName(rows.where("id = 'a'").withColumn("label", F.lit("two")))
    kept = set()
    for x in (two, two.orderBy(F.desc("label"))):
        points.upsert(x, path)
        kept.add(points.read_points(spark, path).where("id = 'a'").first().label)
    assert len(kept) == 1
    with pytest.raises(ValueError):
        points.upsert(rows.withColumn("vector", F.array(F.lit(1.0)).cast("array<float>")), path)


def test_stream_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"iris": ["http://e/1"], "label": "a", "embedding_text": "t"}\n')
    path = str(tmp_path / "points")
    for check in ("c1", "c2"):  # the second run sees the file as new
        stream_points(spark, str(folder), "g", path, HashingEmbedder(DIM), str(tmp_path / check)).awaitTermination()
    assert points.read_points(spark, path).count() == 1


def test_evaluation(spark):
    rows = [("q", "g", "knn", i + 1, i, 1.0 - i / 10) for i in range(4)] + [("q", "g", "in_graph", i + 1, x, 1.0 - x / 10) for i, x in enumerate([0, 2, 3])] + [("q", "g", "all_graph", i + 1, x, s) for i, (x, s) in enumerate([(0, 1.0), (9, 0.95), (8, 0.85)])]
    hits = spark.createDataFrame(rows, "query_id string, target_graph string, mode string, rank int, id int, score double")
    got = {(r.mode, r.k): (r.overlap, r.recall) for r in evaluate.recall_table(hits, (1, 4)).collect()}
    assert got == {("in_graph", 1): (1, 1.0), ("in_graph", 4): (3, 0.75), ("all_graph", 1): (1, 1.0), ("all_graph", 4): (1, 0.25)}
    assert [r.id for r in evaluate.missed_points(hits).collect()] == [1]
    assert tuple(evaluate.missed_summary(hits).first()) == (1.0, 1)
    assert {r.range for r in evaluate.score_ranges(hits).where("mode = 'knn'").collect()} == {"0.70 to 1.00"}
    assert "| 4 | 0.750 | 0.250 |" in evaluate.report(hits, (1, 4))
    none = hits.where("mode <> 'knn'")
    assert evaluate.recall_table(none).count() == 0 and tuple(evaluate.missed_summary(none).first()) == (0.0, 0)


def test_run_evaluation(spark):
    p = planted(spark, a=[i / 50 for i in range(50)], b=[i / 60 for i in range(50)])
    hits = evaluate.run(p, [("q", "a", UNIT)], 5)
    assert {r["mode"]: r["count"] for r in hits.groupBy("mode").count().collect()} == {"knn": 5, "in_graph": 5, "all_graph": 5}


def test_run_all_equals_the_searches_of_each_query(spark, small, monkeypatch):
    import numpy as np

    from graphloom.plans import catalog

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=DIM)], None if i % 17 == 1 else f"g{i % 3}") for i in range(300)]
    p = spark.createDataFrame([*rows, (900, None, "g0"), (901, [0.0] * DIM, "g0")], "id long, vector array<float>, graph string")
    monkeypatch.setattr(evaluate, "QUERY_BLOCK", 2)
    monkeypatch.setattr(evaluate, "POINT_BLOCK", 100)
    got = {}
    for r in evaluate.run_all(p, F.col("id") % 50 == 0, 8).collect():
        got.setdefault((r.query_id, r.mode), {})[r.rank] = r.id
    usable = p.where("id < 900")
    for q in range(0, 300, 150):
        inside = usable.where(F.col("graph") == rows[q][2])
        for mode, want in (("knn", search.top_k(inside, rows[q][1], 8)), ("in_graph", search.approximate_top_k(inside, rows[q][1], 8)), ("all_graph", search.approximate_top_k(usable, rows[q][1], 8))):
            assert [got[q, mode][i + 1] for i in range(8)] == [r.id for r in want.orderBy(F.desc("score"), "id").collect()]
    assert {q for q, _ in got} == set(range(0, 300, 50))
    asked = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 50 = 0 AND label IS NOT NULL")
    counts = {r.target_graph: r.queries for r in catalog.QUERIES["recall_summary"](spark, small).where("k = 1").collect()}
    assert counts == {str(r.label): r["count"] for r in asked.groupBy("label").count().collect()}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(["http://e/1"], "é", "label: é\nx: 1", 1)], "iris array<string>, label string, embedding_text string, iri_count long")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["label"] == "é"
    assert sinks.write_json(rows, tmp_path / "a.json") == 1 and json.loads((tmp_path / "a.json").read_text())[0]["iri_count"] == 1
    assert sinks.write_json(rows.where(F.lit(False)), tmp_path / "e.json") == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    sinks.write_text(rows, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t"), wholetext=False).collect()] == ["label: é", "iris:", "  - http://e/1", "label: é", "x: 1", "---"]
