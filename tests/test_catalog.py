import json

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, small, duck, name):
    found = entry.queries()[name](spark, small)
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(names)
    assert rounded(found.select(*sorted(names)).collect()) == rounded([tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_top_k_per_graph_limits_before_the_exchange(spark, small):
    plan = catalog.QUERIES["survey_topk_per_graph"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_the_nested_survey_joins_written_tables_and_agrees_with_the_flat_queries(spark, small):
    found = catalog.QUERIES["nested_type_samples"](spark, small)
    assert not [f for f in found.inputFiles() if small in f]  # the graph itself is in no join of the last plan
    nested = {r["type"]: json.loads(r.survey) for r in found.collect()}
    assert {t: x["count"] for t, x in nested.items()} == {r["type"]: r["count"] for r in catalog.QUERIES["type_counts"](spark, small).collect()}
    lits = {(t, x["predicate"], x["count"], "|".join(x["values"])) for t, row in nested.items() for x in row.get("literal_predicates", [])}
    assert lits == {(r["type"], r.predicate, r["count"], r["values"]) for r in catalog.QUERIES["literal_predicate_stats"](spark, small).collect()}
    objs = [(t, x) for t, row in nested.items() for x in row.get("object_predicates", [])]
    for name, key in (("object_types", "object_type"), ("object_label_predicates", "label_predicate")):
        got = {(t, x["predicate"], y[key], y["count"]) for t, x in objs for y in x.get(name, [])}
        flat = catalog.QUERIES["object_type_stats" if key == "object_type" else "object_label_stats"](spark, small)
        assert got and got == {(r["type"], r.predicate, r[key], r["count"]) for r in flat.collect()}
