"""Triples of formats that have no line structure: Turtle, TriG and RDF/XML.

Prefixes and nesting reach over a whole file, so a file is parsed by one task,
which yields triples as it reads; large graphs are better kept as N-Triples or
Parquet, which are split.  Rows are those of ``TRIPLES`` without the graph of
the file: (graph or None, subject, predicate, object), a term being (kind,
value, language, datatype).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

from ..functions.terms import BNODE, IRI, LITERAL, RDF_TYPE

Term = tuple[str, str, str | None, str | None]

# Public RDF, XML and schema vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
XSD = "http://www.w3.org/2001/XMLSchema#"

_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_LOCAL = r"(?:[\w:%\-]|\\[_~.\-!$&'()*+,;=/?#@%]|\.+(?=[\w:%\\\-]))*"
_TOKEN = re.compile(
    r"(?P<skip>(?:\s+|\#[^\n\r]*)+)"
    r"|(?P<iri><[^\x00-\x20<>\"{}|^`]*>)"
    r"|(?P<text>\"\"\"(?:\"{0,2}(?:[^\"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*')"
    r"|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"
    r"|(?P<double>[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]+)|(?P<decimal>[+-]?[0-9]*\.[0-9]+)|(?P<integer>[+-]?[0-9]+)"
    r"|(?P<bnode>_:\w(?:[\w.\-]*[\w\-])?)"
    rf"|(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:{_LOCAL})"
    r"|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\](){}])",
    re.S,
)


def _plain(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text)


def _resolved(base: str, ref: str) -> str:
    """An absolute IRI as it is, a relative one by the base; an empty fragment stays."""
    if not base or _SCHEME.match(ref):
        return ref
    found = urljoin(base, ref)
    return found + "#" if ref.endswith("#") and not found.endswith("#") else found


def _iri(value: str) -> Term:
    return (IRI, value, None, None)


class _Nodes:
    """Names for nodes without one, told apart by file."""

    def __init__(self, path: str) -> None:
        self.head, self.n = f"_:f{zlib.crc32(path.encode()):08x}n", 0

    def new(self) -> Term:
        self.n += 1
        return (BNODE, f"{self.head}{self.n}", None, None)


class _Turtle:
    """A reader of one text; ValueError names file and line of what it cannot read."""

    def __init__(self, text: str, path: str, base: str) -> None:
        self.text, self.path, self.base, self.at = text, path, base, 0
        self.prefixes: dict[str, str] = {}
        self.nodes, self.graph = _Nodes(path), None
        self.out: list[tuple[str | None, Term, Term, Term]] = []
        self.step()

    def step(self) -> None:
        """Goes on to the next token."""
        while True:
            if self.at >= len(self.text):
                self.kind, self.word = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                raise self.error()
            self.begin, self.at = m.start(), m.end()
            if m.lastgroup != "skip":
                self.kind, self.word = m.lastgroup, m[0]
                return

    def error(self) -> ValueError:
        line = self.text.count("\n", 0, self.at) + 1
        return ValueError(f"{self.path}:{line}: cannot be read: {self.text[self.at : self.at + 60]!r}")

    def take(self, word: str) -> None:
        if self.word != word:
            raise self.error()
        self.step()

    def statements(self) -> Iterator[tuple[str | None, Term, Term, Term]]:
        while self.kind != "end":
            self.statement()
            yield from self.out
            self.out.clear()

    def statement(self) -> None:
        low = self.word.lower()
        if low in ("@prefix", "@base", "prefix", "base") and self.kind in ("at", "word"):
            self.step()
            self.directive(low)
        elif self.word == "{" or (low == "graph" and self.kind == "word"):
            if self.word != "{":
                self.step()
                self.block(self.term()[1])
            else:
                self.block(None)
        else:
            lone = self.word == "["
            subject = self.term()
            if self.word == "{":
                self.block(subject[1])
                return
            if not (lone and self.word == "."):
                self.predicates(subject)
            self.take(".")

    def directive(self, word: str) -> None:
        name = None
        if word.endswith("prefix"):
            if self.kind != "name" or not self.word.endswith(":"):
                raise self.error()
            name = self.word[:-1]
            self.step()
        if self.kind != "iri":
            raise self.error()
        value = _resolved(self.base, _plain(self.word[1:-1]))
        self.step()
        if name is None:
            self.base = value
        else:
            self.prefixes[name] = value
        if word.startswith("@"):
            self.take(".")

    def block(self, graph: str | None) -> None:
        self.take("{")
        self.graph = graph
        while self.word != "}":
            lone = self.word == "["
            subject = self.term()
            if not (lone and self.word in (".", "}")):
                self.predicates(subject)
            if self.word == ".":
                self.step()
            elif self.word != "}":
                raise self.error()
        self.step()
        self.graph = None

    def predicates(self, subject: Term) -> None:
        while True:
            if self.kind == "word" and self.word == "a":
                predicate = _iri(RDF_TYPE)
                self.step()
            else:
                predicate = self.term()
                if predicate[0] != IRI:
                    raise self.error()
            while True:
                self.out.append((self.graph, subject, predicate, self.term()))
                if self.word != ",":
                    break
                self.step()
            if self.word != ";":
                return
            while self.word == ";":
                self.step()
            if self.word in (".", "]", "}"):
                return

    def term(self) -> Term:
        kind, word = self.kind, self.word
        if kind == "mark" and word in "[(":
            self.step()
            return self.nested() if word == "[" else self.listed()
        if kind == "iri":
            found = _iri(_resolved(self.base, _plain(word[1:-1])))
        elif kind == "name":
            prefix, local = word.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"{self.path}: prefix {prefix}: is not declared")
            found = _iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        elif kind == "bnode":
            found = (BNODE, word, None, None)
        elif kind == "text":
            return self.literal()
        elif kind in ("integer", "decimal", "double"):
            found = (LITERAL, word, None, XSD + kind)
        elif kind == "word" and word in ("true", "false"):
            found = (LITERAL, word, None, XSD + "boolean")
        else:
            raise self.error()
        self.step()
        return found

    def literal(self) -> Term:
        long = 3 if self.word[:3] in ('"""', "'''") and len(self.word) >= 6 else 1
        value = _plain(self.word[long:-long])
        self.step()
        if self.kind == "at":
            lang = self.word[1:]
            self.step()
            return (LITERAL, value, lang, None)
        if self.kind == "type":
            self.step()
            return (LITERAL, value, None, self.term()[1])
        return (LITERAL, value, None, None)

    def nested(self) -> Term:
        node = self.nodes.new()
        if self.word != "]":
            self.predicates(node)
        self.take("]")
        return node

    def listed(self) -> Term:
        items = []
        while self.word != ")":
            if self.kind == "end":
                raise self.error()
            items.append(self.term())
        self.step()
        rest = _iri(RDF + "nil")
        for item in reversed(items):
            node = self.nodes.new()
            self.out += [(self.graph, node, _iri(RDF + "first"), item), (self.graph, node, _iri(RDF + "rest"), rest)]
            rest = node
        return rest


def read_turtle(text: str, path: str, base: str = "") -> Iterator[tuple[str | None, Term, Term, Term]]:
    """Statements of a Turtle or TriG text."""
    return _Turtle(text, path, base).statements()


class _RdfXml:
    """A reader of one RDF/XML tree."""

    def __init__(self, path: str) -> None:
        self.nodes = _Nodes(path)

    def node(self, at: ET.Element, base: str, lang: str | None) -> Iterator[tuple[None, Term, Term, Term]]:
        """Statements of a node element; the last item yielded by its caller is its subject."""
        base, lang = at.get(f"{{{XML}}}base", base), at.get(f"{{{XML}}}lang", lang)
        me = self.subject(at, base)
        if at.tag != f"{{{RDF}}}Description":
            yield None, me, _iri(RDF_TYPE), _iri(_name(at.tag))
        yield from self.attributes(at, me, base, lang)
        members = 0
        for child in at:
            if child.tag == f"{{{RDF}}}li":
                members += 1
                yield from self.property(child, me, f"{RDF}_{members}", base, lang)
            else:
                yield from self.property(child, me, _name(child.tag), base, lang)

    def subject(self, at: ET.Element, base: str) -> Term:
        """The node that an element stands for; one without a name gets one, which stays with the element."""
        if (about := at.get(f"{{{RDF}}}about")) is not None:
            return _iri(_resolved(base, about))
        if (name := at.get(f"{{{RDF}}}ID")) is not None:
            return _iri(_resolved(base, "#" + name))
        if (name := at.get(f"{{{RDF}}}nodeID")) is None:
            name = self.nodes.new()[1][2:]
            at.set(f"{{{RDF}}}nodeID", name)
        return (BNODE, "_:" + name, None, None)

    def attributes(self, at: ET.Element, me: Term, base: str, lang: str | None) -> Iterator[tuple[None, Term, Term, Term]]:
        for key, value in at.attrib.items():
            if key == f"{{{RDF}}}type":
                yield None, me, _iri(RDF_TYPE), _iri(_resolved(base, value))
            elif key.startswith("{") and not key.startswith((f"{{{RDF}}}", f"{{{XML}}}")):
                yield None, me, _iri(_name(key)), (LITERAL, value, lang, None)

    def property(self, at: ET.Element, me: Term, predicate: str, base: str, lang: str | None) -> Iterator[tuple[None, Term, Term, Term]]:
        base, lang = at.get(f"{{{XML}}}base", base), at.get(f"{{{XML}}}lang", lang)
        p, how, children = _iri(predicate), at.get(f"{{{RDF}}}parseType"), list(at)
        if how == "Literal":
            inside = (at.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
            yield None, me, p, (LITERAL, inside, None, RDF + "XMLLiteral")
        elif how == "Resource":
            node = self.nodes.new()
            yield None, me, p, node
            for child in children:
                yield from self.property(child, node, _name(child.tag), base, lang)
        elif how == "Collection":
            rest = _iri(RDF + "nil")
            for child in reversed(children):
                node = self.nodes.new()
                yield from self.node(child, base, lang)
                yield None, node, _iri(RDF + "first"), self.subject(child, child.get(f"{{{XML}}}base", base))
                yield None, node, _iri(RDF + "rest"), rest
                rest = node
            yield None, me, p, rest
        elif children:
            for child in children:
                yield from self.node(child, base, lang)
                yield None, me, p, self.subject(child, child.get(f"{{{XML}}}base", base))
        elif (to := at.get(f"{{{RDF}}}resource")) is not None:
            yield None, me, p, _iri(_resolved(base, to))
            yield from self.attributes(at, _iri(_resolved(base, to)), base, lang)
        elif f"{{{RDF}}}nodeID" in at.attrib or any(k.startswith("{") and not k.startswith((f"{{{RDF}}}", f"{{{XML}}}")) for k in at.attrib):
            node = self.subject(at, base)
            yield None, me, p, node
            yield from self.attributes(at, node, base, lang)
        else:
            kind = at.get(f"{{{RDF}}}datatype")
            yield None, me, p, (LITERAL, at.text or "", None if kind else lang, _resolved(base, kind) if kind else None)


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def read_rdfxml(text: str, path: str, base: str = "") -> Iterator[tuple[str | None, Term, Term, Term]]:
    """Statements of an RDF/XML text; ValueError names the file of one that is no XML."""
    try:
        root = ET.fromstring(text.encode("utf-8"))
    except ET.ParseError as error:
        raise ValueError(f"{path}: {error}") from error
    reader = _RdfXml(path)
    base, lang = root.get(f"{{{XML}}}base", base), root.get(f"{{{XML}}}lang")
    for node in list(root) if root.tag == f"{{{RDF}}}RDF" else [root]:
        yield from reader.node(node, base, lang)


READERS = {"turtle": read_turtle, "trig": read_turtle, "rdfxml": read_rdfxml}
