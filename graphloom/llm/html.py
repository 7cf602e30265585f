"""Main text of web pages by tag-path ratios.

Every block of text belongs to a tag path, the tags from the root down to it.
For each path of a page the text length, punctuation and number of blocks are
summed; the density of text per block, of punctuation and the share of text
outside links are fused to one score, scores are smoothed over neighbouring
blocks in page order, and blocks whose smoothed score reaches a threshold that
comes from the page itself are its content.  Subtrees that by tag, role or
name cannot be content (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) never take part.

A mark (``article``, ``main`` or ``role=main``) is a prior: scores of marked
blocks are divided, those of others multiplied, by the share of the page's score
that is outside of marks.  If a mark holds nearly all of it, only paths of links
fail within; if it holds little, as teasers do, the text elsewhere is content.
Paths and neighbours inside and outside of marks are apart.  Of marked blocks,
list items that are links are left out; of others, all that are links.  If
nothing reaches the threshold, the marked text stays.  Pages are independent of each other: no shuffle, memory
bounded by one page.  Null and empty html gives an empty text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of the HTML standard, by their part here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
SKIP = frozenset("head nav header footer aside form script style noscript template title iframe object svg math select button textarea dialog menu canvas audio video map fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "head"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role names that mark what is not content.
NOISE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar related recommended recommendations promoted sponsor sponsored ad ads advert adverts advertisement advertising cookie cookies consent gdpr notice notification newsletter subscribe subscription signup login comment comments commentlist disqus replies reply respond pagination pager popup modal complementary contentinfo disclaimer".split()
)
# Words that mark it only if no word of KEEP stands beside them.
MAYBE = frozenset("header side rail aside promo promotion banner alert share sharing social discussion overlay widget widgets toolbar skip legal copyright form search searchbox dialog tags author bio byline".split())
KEEP = frozenset("article main content post body entry story text".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: The share of a page's score outside of marks is taken to be this at least.
LEAST_OUTSIDE = 0.02

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in RAW}
# Open elements that an opening one ends.
CLOSES = {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"), "option": ("option",)}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
_POINTS = re.compile(r"[.,;:!?。、，！？…]")


class _Node:
    """An open element; ``path`` stands for the tags from the root down to it."""

    __slots__ = ("tag", "path", "skip", "main", "link", "block")

    def __init__(self, tag: str, above: _Node | None, skip: bool, main: bool) -> None:
        self.tag, self.skip, self.main = tag, skip, main
        self.path = hash((above.path, tag)) if above else 0
        self.link = tag == "a" or bool(above and above.link)
        self.block = self if above is None or tag in BLOCK else above.block


def _noise(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element cannot be content, and whether it marks the article.

    inside: it stands in an article, where a header holds the title.
    """
    main = tag in ("article", "main")
    if tag in SKIP and not (inside and tag == "header"):
        return True, False
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, main
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words = set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if name == "role" and "main" in words:
                main = True
            elif (words & NOISE or words & MAYBE and not words & KEEP) and tag not in ("body", "html", "article", "main"):
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return tag not in ("body", "html"), main
    return False, main


def text_blocks(page: str) -> list[tuple[str, _Node, int]]:
    """Blocks of a page in order: text, innermost block element, characters inside links."""
    stack = [_Node("", None, False, False)]
    opened: Counter[str] = Counter()
    out: list[tuple[str, _Node, int]] = []
    parts: list[str] = []
    links, owner = 0, stack[0]

    def end_block() -> None:
        nonlocal links
        if parts:
            text = _WHITE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, owner, min(links, len(text))))
            parts.clear()
        links = 0

    def leave(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def innermost(tag: str) -> int:
        """Place of the innermost open element of this tag, 0 if there is none to close."""
        if opened[tag] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    return i
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
        return 0

    def add(text: str) -> None:
        nonlocal links, owner
        top = stack[-1]
        if not text or top.skip:
            return
        text = entities.unescape(text)
        if not parts:
            if not text.strip():
                return
            owner = top.block
        parts.append(text)
        if top.link:
            links += len(text)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if not tag:
            continue
        if end:
            if tag in BLOCK:
                end_block()
            if i := innermost(tag):
                leave(i)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            end_block()
            if tag in CLOSES_P and (i := innermost("p")):
                leave(i)
            elif tag in CLOSES:
                while stack[-1].tag in CLOSES[tag]:
                    leave(len(stack) - 1)
        if tag in VOID or attributes.endswith("/"):
            continue
        top = stack[-1]
        skip, marks = _noise(tag, attributes, top.main)
        stack.append(_Node(tag, top, top.skip or skip, (top.main or marks) and not skip))
        opened[tag] += 1
        if tag in RAW:
            close = _CLOSE[tag].search(page, at)
            at = close.start() if close else size
    end_block()
    return out


def main_text(page: str | None, smooth: int = 1, strength: float = 0.5) -> str:
    """The article of a page, one line per block.

    smooth: blocks on each side over which scores are averaged.  strength: share
    of the page's mean score, weighted by text, from which a block is content.
    """
    found = text_blocks(page or "")
    paths: dict[tuple[int, bool], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for text, node, links in found:
        sums = paths[node.path, node.main]
        for i, x in enumerate((len(text), len(_POINTS.findall(text)), links, 1)):
            sums[i] += x

    def score(node: _Node) -> float:
        length, points, links, count = paths[node.path, node.main]
        share = 1 - links / length
        return share * share * (length / count) ** 0.5 * (1 + points / count) ** 0.5

    raw = [score(b[1]) for b in found]
    for i in range(len(found) - 2, -1, -1):  # a heading counts as what it heads
        if found[i][1].tag in HEADINGS:
            raw[i] = max(raw[i], raw[i + 1])
    total = sum(len(b[0]) for b in found)
    weight = sum(s * len(b[0]) for s, b in zip(raw, found, strict=True))
    limit = strength * weight / max(1, total)
    inside = sum(s * len(b[0]) for s, b in zip(raw, found, strict=True) if b[1].main)
    outside = max(LEAST_OUTSIDE, 1 - inside / weight) if weight else 1.0
    kept = []
    for i, (text, node, links) in enumerate(found):
        near = [raw[j] for j in range(max(0, i - smooth), min(len(found), i + smooth + 1)) if found[j][1].main == node.main]
        fused = (raw[i] + sum(near) / len(near)) / 2
        fused = fused / outside if node.main else fused * outside
        if fused >= limit and (node.tag != "li" or links < 0.8 * len(text) if node.main else links < len(text)):
            kept.append(text)
    return "\n".join(kept or [b[0] for b in found if b[1].main])


def extract_main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page; a null page has an empty one.  Other columns stay."""
    if text in df.columns:
        raise ValueError(f"column {text} exists already; name another")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = [main_text(x) for x in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)]))
