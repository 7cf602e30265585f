"""Text expressions: readable names from IRIs, digests, stable scores and point ids."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import BNODE, IRI, LITERAL

#: Unicode white space as Python's str.split takes it; Java's \s is ASCII only.
WHITE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: Namespace of point ids, a fixed value.
POINT_NAMESPACE = "223675f1-af1e-4ce9-b7b6-849178e8c69e"


def normalize_label(text: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def humanize(text: Column) -> Column:
    """Underscores, dashes and camel case become spaces; case stays."""
    spaced = F.translate(text, "_-", "  ")
    return normalize_label(F.regexp_replace(spaced, r"(\p{IsLowercase})(?=\p{IsUppercase})", "$1 "))


def iri_fragment(iri: Column) -> Column:
    """What follows the last #, else the last /, else all of it."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).when(F.contains(iri, F.lit("/")), F.substring_index(iri, "/", -1)).otherwise(iri)


def fallback_label(iri: Column) -> Column:
    return humanize(iri_fragment(iri))


def stable_score(s: Column, p: Column, o: Column) -> Column:
    """Order of objects that does not depend on storage."""
    return F.sha2(F.concat_ws("\t", s, p, o), 256)


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def shard_of(digest: Column, shards: int) -> Column:
    """Shard of a hex digest by its first 8 digits."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(shards))


def point_id(graph: Column, iri: Column, text: Column) -> Column:
    """UUIDv5 of graph, IRI and text, so that the same record has the same id again."""
    name = F.concat(graph, F.lit("\0"), F.coalesce(iri, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit("")))
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.substr(F.lit("89ab"), nibble + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def best_label(kind: Column, value: Column, literal: Column, fallback: bool = True, humanized: bool = True) -> Column:
    """Label of a term, given the first literal of its label predicates.

    An empty first literal is passed over for the IRI, not for the next predicate.
    """
    other = (fallback_label(value) if humanized else value) if fallback else F.lit(None).cast("string")
    return F.when(kind == LITERAL, value).when(kind == BNODE, F.lit(None).cast("string")).when(F.length(literal) > 0, literal).otherwise(other)


def display_label(kind: Column, value: Column, literal: Column) -> Column:
    """Label as shown: normalised, and the term itself where nothing is left."""
    label = normalize_label(best_label(kind, value, literal))
    return F.when(F.length(label) > 0, label).otherwise(value)


def template_parts(template: str) -> list[str | tuple[str]]:
    """Literal text and fields, in order, of a template such as ``{id}: {name}``."""
    out: list[str | tuple[str]] = []
    at = 0
    for m in re.finditer(r"\{([^{}]+)\}", template):
        out += [template[at : m.start()], (m[1].strip(),)]
        at = m.end()
    return [x for x in [*out, template[at:]] if x]


def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """The template with fields filled in, normalised; unknown or missing ones are empty; null if nothing is left."""
    none = F.lit("")
    parts = [F.lit(x) if isinstance(x, str) else F.coalesce(values.get(x[0], none), none) for x in template_parts(template)]
    text = normalize_label(F.concat(*parts)) if parts else none
    return F.when(F.length(text) > 0, text)


def percent_encode(text: Column) -> Column:
    """Every reserved character percent-encoded."""
    out = F.url_encode(text)
    for a, b in (("\\+", "%20"), ("\\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def file_stem(path: Column) -> Column:
    """Name of a file without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def more_text(count: Column) -> Column:
    """How many IRIs stand behind the one shown."""
    return F.when(count > 1, F.concat(F.lit(" (+"), (count - 1).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))


def is_iri(kind: Column) -> Column:
    return kind == IRI
