"""A training corpus from raw documents, in stages.

Each stage takes the session, the documents that its predecessor kept and the
folder of the tables, and returns documents with the columns of the table; the
last one returns packed pieces.  ``run`` writes the result of every stage to
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, packing, quality, secrets, substrings
from graphloom.llm.bpe import read_ranks
from graphloom.llm.shared import bounded_batches, written


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with their length after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: 5-word shingles, similarity of 0.8."""
    return jaccard.keep_one(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without word sequences of 20 or more that an earlier one has; empty ones go."""
    left = substrings.remove_repeats(docs)
    return _counted(left.where("n_words = 0 OR n_removed < n_words").drop("n_words", "n_removed"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _counted(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The stages tag and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
