"""Document quality rules in a short-circuit cascade, in built-in functions only.

A rule is a condition that rejects a document.  The cost of each rule and the
share of documents it rejects are measured on a bounded sample, and the rules
are put in order of rejection per cost.  The cascade is one CASE expression, so
a document is put to the next rule only if no rule before rejected it.  The
order decides how much is computed, never the verdict.

Words and lines of a text are made once, and all measures and rules read them;
dear expressions stay within the CASE.

Everything is computed within a row: no shuffle, nothing collected but the
sample.  A null text counts as empty; an empty text has no words and fails the
rule on few words.  Repeated windows are compared by 64-bit hash within one
text.  Other columns stay as they are; a clash with a new column is an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_WINDOW = 8
#: Rows and characters of each on which costs are measured, from one row in SAMPLE_SHARE.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_COPIES, SAMPLE_SHARE = 256, 20_000, 2, 64

_SPACE = "\t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), "")


def line_array(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def window_hashes(words: Column, size: int = WORD_WINDOW) -> Column:
    """A hash of each run of ``size`` words, a power of two: of pairs, pairs of pairs, and so on."""
    if size & (size - 1):
        raise ValueError("the size of a window is a power of two")

    def doubled(width: int) -> Callable[[Column], Column]:
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width)))

    out = F.transform(words, lambda w: F.xxhash64(w))
    width = 1
    while width < size:
        out, width = _let(out, doubled(width)), width * 2
    last = F.size(words) - (size - 1)
    return F.when(last >= 1, F.slice(out, 1, F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def _has_repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def _repeat_words(hashes: Column, size: int) -> Column:
    """Words in windows whose hash comes twice; only texts with such windows are looked at further."""

    def covered(ordered: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            same = F.coalesce(F.get(ordered, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(ordered, i + 1).h == x.h, F.lit(False))
            return F.when(same, x.i)

        places = F.sort_array(F.filter(F.transform(ordered, repeated), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a.n + F.least(F.lit(size), p - a.last)).cast("long").alias("n"), p.alias("last")), lambda a: a.n)

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(_has_repeats(hashes), _let(pairs, covered)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Parts:
    """What rules read of a document: its text, words and lines, and measures of them."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @staticmethod
    def of(text: Column, words: Column, lines: Column, size: int = WORD_WINDOW) -> Parts:
        """Measures as expressions, computed only where they are read."""
        return Parts(
            text,
            words,
            lines,
            F.size(words).cast("long"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            _let(window_hashes(words, size), lambda h: _repeat_words(h, size)),
        )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shared(df: DataFrame, text: str) -> DataFrame:
    """The rows with _words and _lines, in a projection of their own."""
    if taken := {"_words", "_lines"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already")
    return df.withColumns({"_words": word_array(_text(text)), "_lines": line_array(_text(text))})


def with_features(df: DataFrame, text: str = "text", size: int = WORD_WINDOW, keep: bool = False) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long); keep: _words and _lines too."""
    if taken := set(df.columns) & {*MEASURES}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    parts = Parts.of(_text(text), F.col("_words"), F.col("_lines"), size)
    out = _shared(df, text).withColumns({m: getattr(parts, m) for m in MEASURES})
    return out if keep else out.drop("_words", "_lines")


def measured_parts(text: str = "text") -> Parts:
    """The parts of a table from ``with_features`` that kept its arrays."""
    return Parts(_text(text), F.col("_words"), F.col("_lines"), *map(F.col, MEASURES))


@dataclass(frozen=True)
class Rule:
    """name, and the condition on a document's parts that rejects it."""

    name: str
    rejects: Callable[[Parts], Column]


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _stutter(words: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


#: Rejections that hold whatever else a document is like.
BASE_RULES = (
    Rule("few_words", lambda p: p.n_words < 20),
    Rule("repeated_windows", lambda p: p.n_repeat_words * 100 > p.n_words * 30),
)
#: Further rules; each threshold lies well clear of ordinary prose.
RULES = (
    Rule("symbols", lambda p: p.n_symbols * 100 > p.n_words * 10),
    Rule("exclamations", lambda p: F.regexp_count(p.text, F.lit("!")) * 100 > p.n_words * 20),
    Rule("capitals", lambda p: F.regexp_count(p.text, F.lit(r"\p{Lu}")) * 100 > _letters(p.text) * 40),
    Rule("repeated_lines", lambda p: p.n_dup_lines * 100 > F.size(p.lines) * 40),
    Rule("stutter", lambda p: _stutter(p.words) * 100 > p.n_words * 30),
    Rule("word_length", lambda p: (p.word_chars < p.n_words * 2) | (p.word_chars > p.n_words * 14)),
    Rule("few_letters", lambda p: _letters(p.text) * 100 < p.word_chars * 50),
)


def _sample(df: DataFrame, text: str, rows: int) -> list[str]:
    """Starts of some texts: of a random share of the rows the first; a table too small for that gives random ones."""
    start = df.select(F.left(_text(text), F.lit(SAMPLE_CHARS)).alias("t"))
    found = start.where(F.rand(17) * SAMPLE_SHARE < 1).take(rows)
    if len(found) < rows:
        found = start.orderBy(F.rand(17)).limit(rows).collect()
    return [r.t for r in found]


def measure(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds and share rejected of each rule on ``rows`` rows, beyond what words and lines take."""
    spark = df.sparkSession
    sample = _sample(df, text, rows)
    if not sample:
        return {r.name: (1.0, 0.0) for r in rules}
    local = spark.createDataFrame([(x,) for x in sample], "t string").coalesce(1)
    local = _shared(local.select("t", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_COPIES)))).select("t"), "t").cache()  # of a bounded sample
    parts = Parts.of(F.col("t"), F.col("_words"), F.col("_lines"))

    def run(condition: Column) -> tuple[float, int]:
        query = local.select(F.count_if(condition).alias("n"))
        query.collect()  # compiles
        began = time.perf_counter()
        n = query.collect()[0].n
        return time.perf_counter() - began, n

    empty, _ = run(F.length("t") < 0)
    found = {}
    for rule in rules:
        seconds, n = run(rule.rejects(parts))
        found[rule.name] = (max(seconds - empty, 1e-4), n / (len(sample) * SAMPLE_COPIES))
    local.unpersist()
    return found


def in_order(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, the best first; a rule that rejected nothing counts as half a row."""
    least = 0.5 / SAMPLE_ROWS
    return tuple(sorted(rules, key=lambda r: (-max(measured[r.name][1], least) / measured[r.name][0], r.name)))


def first_rejection(rules: tuple[Rule, ...], parts: Parts) -> Column:
    """Name of the first rule in order that rejects a document, null if none does."""
    out = F.when(rules[0].rejects(parts), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects(parts), rule.name)
    return out


def quality_cascade(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text: str = "text", out: str = "rejected_by", sample: DataFrame | None = None) -> DataFrame:
    """Adds the name of a rule that rejects each document, null for documents to keep.

    Which of several rejecting rules is named depends on the measured order;
    whether one is named does not.  ``sample``: where costs are measured, the
    input itself if not given.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    ordered = in_order(rules, measure(sample if sample is not None else df, rules, text))
    t = _text(text)
    # one expression, as a filter on it would be moved below a projection of the arrays and make them again for every use
    verdict = _let(word_array(t), lambda words: _let(line_array(t), lambda lines: first_rejection(ordered, Parts.of(t, words, lines))))
    return df.withColumn(out, verdict)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns as they were."""
    return quality_cascade(df, text=text, out="_rejected_by").where(F.col("_rejected_by").isNull()).drop("_rejected_by")
