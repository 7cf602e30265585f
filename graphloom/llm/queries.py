"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the digest of what they decode to."""
    from .bpe import bpe_encode, read_ranks

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_encode(docs, read_ranks(_vocabulary()), decoded="decoded")
    return done.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by format-preserving pseudonyms."""
    from .pii import Key, pseudonymise

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), "text")
    done = pseudonymise(docs, Key("graphloom"))
    return done.select("doc_id", "text", (F.col("before") != F.col("text")).alias("changed"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: 4-word shingles, similarity of 0.85."""
    from .jaccard import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the fixed patterns, their digest, all spans."""
    from .secrets import find_secrets

    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("secrets", lambda s: s.kind != "learned")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and whether the cascade keeps it."""
    from .quality import BASE_RULES, RULES, first_rejection, in_order, measure, measured_parts, with_features

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = in_order(RULES, measure(docs, RULES))
    parts = measured_parts()
    few, repeated = (r.rejects(parts) for r in BASE_RULES)
    done = with_features(docs, keep=True).withColumn("base_failed", few | repeated)
    kept = F.when(F.col("base_failed"), False).otherwise(first_rejection(rules, parts).isNull())
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every row whose id is divisible by 20."""
    from .neighbours import nearest

    found = nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in its best segmentation under a unigram model."""
    from .bpe import read_ranks
    from .unigram import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, read_ranks(_vocabulary())).drop("text")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    from .bpe import read_ranks
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), read_ranks(_vocabulary()))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat earlier ones, and the digest of the words left."""
    from .substrings import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), joined=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    from .html import extract_main_text

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = extract_main_text(pages).drop("html")
    return done.withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_neighbours": op6_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_best_fit": op8_best_fit,
    "op9_substrings": op9_substrings,
    "op10_main_text": op10_main_text,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op3_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT u, v FROM common JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        way AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
        reach AS (SELECT u, v FROM way UNION SELECT reach.u, way.v FROM reach JOIN way ON way.u = reach.v)
        SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(reach.v)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.u = w.doc_id GROUP BY w.doc_id
    """,
    "op5_quality": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
        places AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM places),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE k > 1) GROUP BY doc_id),
        m AS (
            SELECT doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{{L}}')) AS letters
            FROM w LEFT JOIN covered USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 100 > n_words * 10 OR len(regexp_extract_all(t, '!')) * 100 > n_words * 20
                OR len(regexp_extract_all(t, '\p{{Lu}}')) * 100 > letters * 40 OR n_dup_lines * 100 > len(ls) * 40 OR len([i FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) * 100 > n_words * 30
                OR word_chars < n_words * 2 OR word_chars > n_words * 14 OR letters * 100 < word_chars * 50) AS kept
        FROM m
    """,
    "op9_substrings": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
        late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
        left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(left_.n, 0))::BIGINT AS n_removed, sha256(coalesce(left_.t, '')) AS kept_sha256
        FROM w LEFT JOIN left_ USING (doc_id)
    """,
}
