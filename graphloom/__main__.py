"""Command line: python -m graphloom COMMAND ...

textify, sample, upload, search, survey and graphs; errors go to standard error
with status 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.embedding import HashingEmbedder
from .functions.text import more_text, score_text
from .operators import sampling, search, textify
from .operators.config import Materialization
from .sources import points as P
from .sources import sinks
from .sources.jsonl import read_jsonl
from .sources.triples import load_triples


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Text and vector analytics of knowledge graphs.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text, description=text)
        for place in places:
            made.add_argument(place)
        return made

    c = command("textify", "Write the records of a graph's targets.", "graph", "config", "output")
    c.add_argument("--target", help="one target of the configuration instead of all")
    c.add_argument("--limit", type=int, help="roots of each target")
    c.add_argument("--format", choices=("jsonl", "json", "text"), default="jsonl")
    c = command("sample", "Write a survey of a graph's types, or sampled records of targets.", "graph", "output")
    c.add_argument("--config", help="a configuration whose targets are sampled instead of types")
    c.add_argument("--limit", type=int, default=sampling.SUBJECTS, help="subjects of each type")
    c.add_argument("--values", type=int, default=sampling.VALUES, help="values of each predicate")
    c.add_argument("--seed")
    c.add_argument("--format", choices=("json", "text"), default="json")
    c = command("upload", "Add records of JSON lines to a collection.", "collection")
    c.add_argument("records", nargs="+")
    c.add_argument("--graph", help="name of the graph; by default that of each file")
    c.add_argument("--limit", type=int, help="lines of each file")
    c.add_argument("--create", action="store_true", help="make the collection if there is none")
    for name, text in (("search", "The points most like a text or a node."), ("survey", "The best points of each graph.")):
        c = command(name, text, "collection")
        what = c.add_mutually_exclusive_group(required=True)
        what.add_argument("--text")
        what.add_argument("--node")
        c.add_argument("--include", action="append", default=[], metavar="GRAPH")
        c.add_argument("--exclude", action="append", default=[], metavar="GRAPH")
        c.add_argument("--limit", type=int, default=10 if name == "search" else 5)
        c.add_argument("--json", action="store_true")
        c.add_argument("--repr", action="store_true", help="show the text of points")
        if name == "search":
            c.add_argument("--offset", type=int, default=0)
    c = command("graphs", "Graphs and the number of their points.", "collection")
    c.add_argument("--limit", type=int)
    c.add_argument("--json", action="store_true")
    for c in commands.choices.values():
        if c.prog.split()[-1] in ("upload", "search", "survey"):
            c.add_argument("--dimension", type=int, default=64, help="size of the vectors")
    return top


def hit_dict(hit: Row, with_repr: bool = False) -> dict:
    """A hit as JSON shows it; its text only on request."""
    out = {k: hit[k] for k in ("id", "score", "primary_uri", "iri_count", "label", "graph")}
    return out | {"repr": hit["repr"]} if with_repr else out


def hit_line(hit: Row, with_repr: bool = False) -> str:
    line = f"{hit.score_text}  {hit.graph}  {hit.label}  <{hit.primary_uri}>{hit.more}"
    return line + ("\n    " + hit.repr.replace("\n", "\n    ") if with_repr else "")


def _shown(hits: DataFrame, *keep: str) -> list[Row]:
    """Hits with their score and number of IRIs as text; their number is bounded by the limits of the search."""
    return search.results(hits, *keep).withColumns({"score_text": score_text(F.col("score")), "more": more_text(F.col("iri_count"))}).collect()


def _textify(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    records = textify.in_record_order(textify.textify(load_triples(spark, a.graph), Materialization.from_toml(a.config), a.target, a.limit))
    {"jsonl": sinks.write_jsonl, "json": sinks.write_json, "text": sinks.write_text}[a.format](records, a.output)
    return []


def _sample(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    triples = load_triples(spark, a.graph)
    if a.config:
        found = textify.sample_targets(triples, Materialization.from_toml(a.config), a.limit, a.seed)
    else:
        found = sampling.sample_types(triples, a.limit, a.values, a.seed)
    as_text = sinks.write_targets_text if a.config else sinks.write_samples_text
    (sinks.write_json if a.format == "json" else as_text)(found, a.output)
    return []


def _upload(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    P.ensure_collection(spark, a.collection, a.create)
    embedder, out, total = HashingEmbedder(a.dimension), [], 0
    for path in a.records:
        graph = a.graph or PurePosixPath(path).stem
        n = P.upsert(P.to_points(read_jsonl(spark, path, a.limit), graph, embedder), a.collection)
        out.append(f"{path}: {n} points in {graph}")
        total += n
    return [*out, f"total: {total} points"]


def _collection(spark: SparkSession, path: str) -> DataFrame:
    P.ensure_collection(spark, path)
    return P.read_points(spark, path)


def _search(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    query = search.Query(a.text, a.node, tuple(a.include), tuple(a.exclude), a.limit, a.offset)
    hits = _shown(search.search(_collection(spark, a.collection), query, HashingEmbedder(a.dimension)))
    if a.json:
        return [json.dumps([hit_dict(h, a.repr) for h in hits], ensure_ascii=False, indent=2)]
    return [hit_line(h, a.repr) for h in hits]


def _survey(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    points = _collection(spark, a.collection)
    query = search.Query(a.text, a.node, tuple(a.include), tuple(a.exclude), a.limit)
    every = [r.graph for r in search.facets(points).orderBy("graph").collect()]
    graphs = search.resolve_graphs(every, list(query.include_graphs), list(query.exclude_graphs))
    vector = search.node_vector(points, a.node) if a.node is not None else HashingEmbedder(a.dimension).embed(a.text)
    groups: dict[tuple[int, str], list[Row]] = {}
    for hit in _shown(search.survey(points, graphs, vector, a.limit), "ord"):
        groups.setdefault((hit.ord, hit.graph), []).extend([hit] if hit.id is not None else [])
    if a.json:
        return [json.dumps([{"graph": g, "results": [hit_dict(h, a.repr) for h in hits]} for (_, g), hits in groups.items()], ensure_ascii=False, indent=2)]
    return [line for (_, g), hits in groups.items() for line in (f"{g} ({len(hits)})", *("  " + hit_line(h, a.repr) for h in hits))]


def _graphs(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    rows = search.facets(_collection(spark, a.collection), a.limit).orderBy("graph").collect()
    if a.json:
        return [json.dumps([{"graph": r.graph, "count": r["count"]} for r in rows], ensure_ascii=False, indent=2)]
    return [f"{r.graph}\t{r['count']}" for r in rows]


COMMANDS = {"textify": _textify, "sample": _sample, "upload": _upload, "search": _search, "survey": _survey, "graphs": _graphs}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; its exit status."""
    args = parser().parse_args(argv)
    try:
        lines = COMMANDS[args.command](spark or SparkSession.builder.appName("graphloom").getOrCreate(), args)
    except (ValueError, OSError, PySparkException) as error:
        print("error: " + search.error_status(error)[1].strip().split("\n")[0], file=sys.stderr)
        return 1
    for line in lines:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
