"""Triples from RDF files, from Parquet, and from tables by direct mapping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import BNODE, IRI, LITERAL, RDF_TYPE, RDFS_LABEL, TRIPLES
from ..functions.text import file_stem
from .rdf_files import READERS

# Suffixes of RDF files.
FORMATS = {".nt": "ntriples", ".nq": "nquads", ".ttl": "turtle", ".trig": "trig", ".rdf": "rdfxml", ".xml": "rdfxml", ".jsonld": "jsonld", ".hdt": "hdt", ".parquet": "parquet"}
#: What can be read here; other formats are converted outside.
READABLE = ("ntriples", "nquads", "turtle", "trig", "rdfxml", "parquet")

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*(<[^>]*>|_:[^\s]+)\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:[^\s.]+)?\s*\.\s*(?:#.*)?$"


def guess_format(path: str) -> str:
    """Format by suffix, whatever its case; an unknown one raises ValueError."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported RDF file: {path}")
    return FORMATS[suffix]


def _unescaped(text: Column) -> Column:
    """String escapes of N-Triples undone, a code point escape at a time by its own match."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(part: Column) -> Column:
        code = F.conv(F.substr(part, F.lit(3)), 16, 10).cast("int")
        wide = F.when(code < 0x10000, F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise(
            F.decode(F.unhex(F.concat(F.hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), F.hex(F.lit(0xDC00) + (code - 0x10000) % 1024))), "UTF-16BE")
        )
        out = F.when(~part.startswith("\\"), part).when(part.startswith("\\u") | part.startswith("\\U"), wide)
        for mark, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")):
            out = out.when(part == "\\" + mark, F.lit(char))
        return out.otherwise(F.substr(part, F.lit(2)))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _kind(term: Column) -> Column:
    return F.when(term.startswith("<"), IRI).when(term.startswith("_:"), BNODE).otherwise(LITERAL)


def _value(term: Column) -> Column:
    inside = F.regexp_extract(term, r'(?s)^[<"](.*)[>"](?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    literal = F.regexp_extract(term, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    return F.when(term.startswith("_:"), term).when(term.startswith("<"), _unescaped(inside)).otherwise(_unescaped(literal))


def parse_ntriples(lines: DataFrame, graph: Column | None = None, strict: bool = True) -> DataFrame:
    """Triples of a DataFrame of lines (column value); a bad line raises, or goes if not strict.

    graph: name of the graph; by default that of N-Quads, else null.
    """
    line = F.trim("value")
    rows = lines.where((F.length(line) > 0) & ~line.startswith("#"))
    parts = [F.regexp_extract("value", _LINE, i) for i in range(1, 5)]
    good = F.col("value").rlike(_LINE)
    if strict:
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.substring("value", 1, 200))).cast("boolean")))
    else:
        rows = rows.where(good)
    s, p, o, g = (F.col(x) for x in ("_s", "_p", "_o", "_g"))
    named = F.when(F.length(g) > 0, _value(g)) if graph is None else graph
    rows = rows.select(parts[0].alias("_s"), parts[1].alias("_p"), parts[2].alias("_o"), parts[3].alias("_g"), *([graph.alias("_name")] if graph is not None else []))
    return rows.select(
        (F.col("_name") if graph is not None else named).alias("graph"),
        _kind(s).alias("s_kind"), _value(s).alias("s"), _value(p).alias("p"), _kind(o).alias("o_kind"), _value(o).alias("o"),
        F.when(o.startswith('"'), F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))).alias("o_lang"),
        F.when(o.startswith('"'), F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))).alias("o_datatype"),
    ).dropDuplicates()


#: Triples that a task holds while it parses a file.
_BLOCK = 10_000


def parse_files(files: DataFrame, kind: str, graph: str | None = None) -> DataFrame:
    """Triples of whole files (columns value and path); a file that cannot be read raises an error that names it.

    graph: name of the graph; by default the one that TriG names, else the file's.
    """
    fields = [f.split()[0] for f in TRIPLES.split(", ")]

    def rows(text: str, path: str) -> Iterator[tuple]:
        for named, s, p, o in READERS[kind](text, path):
            yield (graph or named, s[0], s[1], p[1], *o, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, path in zip(batch["value"], batch["path"], strict=True):
                found = rows(text, path)
                while block := list(islice(found, _BLOCK)):
                    yield pd.DataFrame(block, columns=[*fields, "path"], dtype=object)

    parsed = files.select("value", "path").mapInPandas(run, TRIPLES + ", path string")
    if kind != "trig":
        parsed = parsed.withColumn("graph", F.coalesce("graph", file_stem(F.col("path"))))
    return parsed.select(*fields).dropDuplicates()


def load_triples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """The set of triples of a file or folder; the graph is named after the file if not given."""
    kind = guess_format(path)
    if kind not in READABLE:
        raise ValueError(f"{kind} cannot be read here: convert {path} to N-Triples or Parquet")
    if kind == "parquet":
        return spark.read.schema(TRIPLES).parquet(path).dropDuplicates()
    if kind in READERS:
        return parse_files(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), kind, graph)
    lines = spark.read.text(path)
    name = F.lit(graph) if graph is not None else None if kind == "nquads" else file_stem(F.input_file_name())
    return parse_ntriples(lines, name)


# -- direct mapping ------------------------------------------------------------

BASE = "http://example.org/"
_V = BASE + "v/"


def _iri(kind: str, *keys: str) -> Column:
    text: list[Column] = [F.lit(f"{BASE}{kind}/")]
    for i, k in enumerate(keys):
        text += ([F.lit("-")] if i else []) + [F.col(k).cast("string")]
    return F.concat(*text)


# Table, subject, type, literals by predicate, objects by predicate: the mapping of the tables to a graph.
_MAPPING = {
    "region": ("region", ("r_regionkey",), "Region", {RDFS_LABEL: "r_name"}, {}),
    "nation": ("nation", ("n_nationkey",), "Nation", {RDFS_LABEL: "n_name"}, {"inRegion": ("region", "n_regionkey")}),
    "customer": ("customer", ("c_custkey",), "Customer", {RDFS_LABEL: "c_name", _V + "marketSegment": "c_mktsegment"}, {"inNation": ("nation", "c_nationkey")}),
    "supplier": ("supplier", ("s_suppkey",), "Supplier", {RDFS_LABEL: "s_name"}, {"inNation": ("nation", "s_nationkey")}),
    "part": ("part", ("p_partkey",), "Part", {RDFS_LABEL: "p_name", _V + "brand": "p_brand", _V + "partType": "p_type", _V + "size": "p_size"}, {}),
    "orders": ("order", ("o_orderkey",), "Order", {_V + "orderPriority": "o_orderpriority", _V + "orderStatus": "o_orderstatus"}, {"placedBy": ("customer", "o_custkey")}),
    "lineitem": ("lineitem", ("l_orderkey", "l_linenumber"), "LineItem", {_V + "returnFlag": "l_returnflag"}, {"ofOrder": ("order", "l_orderkey"), "ofPart": ("part", "l_partkey"), "suppliedBy": ("supplier", "l_suppkey")}),
}
#: Edges that run against a foreign key: subject, predicate, object.
_REVERSE = {"orders": (("customer", "o_custkey"), "placedOrder", ("order", "o_orderkey"))}


def table_triples(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """Triples of tables: a row is an IRI, a column a predicate, a foreign key an object.

    Each table is scanned once; its triples are made by one explode.
    """
    out = None
    for table in tables:
        kind, keys, type_, literals, objects = _MAPPING[table]
        subject = _iri(kind, *keys)

        def row(s: Column, p: str, o_kind: str, o: Column) -> Column:
            return F.struct(s.alias("s"), F.lit(p).alias("p"), F.lit(o_kind).alias("o_kind"), o.alias("o"))

        made = [row(subject, RDF_TYPE, IRI, F.lit(_V + type_))]
        made += [row(subject, p, LITERAL, F.col(c).cast("string")) for p, c in literals.items()]
        made += [row(subject, _V + p, IRI, _iri(k, c)) for p, (k, c) in objects.items()]
        if reverse and table in _REVERSE:
            (a, c), p, (b, d) = _REVERSE[table]
            made.append(row(_iri(a, c), _V + p, IRI, _iri(b, d)))
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.explode(F.array(*made)).alias("t"))
        rows = rows.where("t.s IS NOT NULL AND t.o IS NOT NULL").select(F.lit("tables").alias("graph"), F.lit(IRI).alias("s_kind"), "t.s", "t.p", "t.o_kind", "t.o", F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no tables given")
    return out
