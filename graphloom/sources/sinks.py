"""Files of records: JSON lines and text in parallel, JSON arrays and pretty text in one stream."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, one object a row, nulls included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def record_text(label: Column, iris: Column, text: Column) -> Column:
    """A record as text: its label, its IRIs, its body and a rule."""
    listed = F.array_join(F.transform(iris, lambda i: F.concat(F.lit("  - "), i)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("label: "), F.coalesce(label, F.lit(""))), F.lit("iris:"), listed, text, F.lit("---"))


def write_text(records: DataFrame, path: str) -> None:
    """A folder of text files of records."""
    records.select(record_text(F.col("label"), F.col("iris"), F.col("embedding_text")).alias("value")).write.text(path)


def write_documents_text(documents: DataFrame, path: str) -> None:
    """A folder of text files of documents in the older form: IRI, text and a rule."""
    documents.select(F.concat_ws("\n", F.concat(F.lit("iri: "), "iri"), "embedding_text", F.lit(""), F.lit("---")).alias("value")).write.text(path)


def write_json(rows: DataFrame, path: str | Path) -> int:
    """One JSON array, written row by row as rows arrive at the driver; their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(rows.toLocalIterator(), start=1):
            body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2)
            f.write((",\n" if n > 1 else "\n") + "\n".join("  " + line for line in body.splitlines()))
        f.write("\n]\n" if n else "]\n")
    return n


def sample_lines(row: Row) -> list[str]:
    """A type's survey as indented text."""
    out = [f"{row.label or row.type} <{row.type}> ({row['count']})"]
    out += [f"  sample: {i}" for i in row.sample_iris]
    for p in row.literal_predicates or []:
        out.append(f"  {p.label} <{p.predicate}> x{p['count']} (mean {p.mean_per_subject:.2f}): {' | '.join(p['values'])}")
    for p in row.object_predicates or []:
        out.append(f"  {p.label} <{p.predicate}> x{p['count']} (mean {p.mean_per_subject:.2f})")
        out += [f"    type {t.label} <{t.object_type}> x{t['count']}" for t in p.object_types or []]
        out += [f"    {t.label} <{t.label_predicate}> x{t['count']}: {' | '.join(t['values'])}" for t in p.object_label_predicates or []]
        out += [f"    object {o.label} <{o.iri}>" for o in p.sample_objects or []]
    return out


def write_samples_text(samples: DataFrame, path: str | Path) -> None:
    """Types' surveys as text; their size is bounded by the number of types and the limits of the survey."""
    with open(path, "w", encoding="utf-8") as f:
        for row in samples.toLocalIterator():
            f.write("\n".join(sample_lines(row)) + "\n\n")


def target_lines(row: Row) -> list[str]:
    """A target's sampled records as text."""
    out = [f"target: {row.target}", f"type: {row.type}", ""]
    for r in row.records:
        out += [f"label: {r.label}", "iris:", *(f"  - {i}" for i in r.iris), "", r.embedding_text, ""]
    return [*out, "---", ""]


def write_targets_text(samples: DataFrame, path: str | Path) -> None:
    """Targets' sampled records as text; their size is bounded by the number of targets and the limit of the sample."""
    with open(path, "w", encoding="utf-8") as f:
        for row in samples.toLocalIterator():
            f.write("\n".join(target_lines(row)) + "\n")


def write_point_sample(points: DataFrame, path: str) -> None:
    """Points in zstd Parquet, a folder for each graph."""
    points.select(F.col("id").alias("point_id"), "label", "iri", "repr", "vector", "graph").write.option("compression", "zstd").partitionBy("graph").parquet(path)
