"""Readers of Turtle and RDF/XML: a document a row, spread over tasks; each gives triples s, p, o, literal, lang.

Null and empty documents have no triples. Blank nodes are named by document, so those of two files never meet. Turtle:
prefixes, base, ``a``, ``;`` and ``,``, nested blank nodes, all literal forms; a collection gives a triple a member;
marks that can't be read are passed over. RDF/XML that isn't well formed is an error that names the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kgspark.plans.graph import Graph
from kgspark.sinks.exports import BASE
from kgspark.sources.graphs import OWL, RDF, RDFS, from_triples, read_text

Triple = tuple[str, str, str, bool, "str | None"]
TRIPLES = "s string, p string, o string, literal boolean, lang string"
_ROWS = pa.schema([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("literal", pa.bool_()), ("lang", pa.string())])
XML = "{http://www.w3.org/XML/1998/namespace}"
#: Prefixes that need no declaration.
PREFIXES = {"": BASE, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": "http://www.w3.org/2001/XMLSchema#", "skos": "http://www.w3.org/2004/02/skos/core#"}
_NAME = r"""[^\s<>"'.;,\[\]()#@^]+"""
_TOKEN = re.compile(
    r'''\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"
    rf"|(?P<number>[+-]?(?:[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?(?![\w:]))|(?P<mark>[.;,\[\]()])|(?P<name>{_NAME}(?:\.+{_NAME})*)",
    re.DOTALL,
)
#: Prefixes in their plain form at the start of a text, in so many characters; documents that share them have them read once.
HEAD = 4096
_PREFIX = re.compile(r"\s*@prefix\s+([A-Za-z][A-Za-z0-9_-]*|):\s*(<[^<>\s]*>)\s*\.\s")
_HEAD = re.compile(rf"(?:{_PREFIX.pattern})*\s*")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unquoted(token: str) -> str:
    width = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]), token[width:-width])


def _blank(document: str) -> str:
    return f"_:{sha256(document.encode()).hexdigest()[:12]}"


@lru_cache(maxsize=64)
def _prefixes(head: str) -> dict[str, str] | None:
    """What the lines above a text declare; None if they say anything else."""
    return {**PREFIXES, **{name: iri[1:-1] for name, iri in _PREFIX.findall(head)}} if _HEAD.fullmatch(head) else None


def turtle_triples(text: str, document: str) -> Iterator[Triple]:
    last = text.rfind("@prefix ", 0, HEAD)
    start = text.find("\n", last, HEAD) + 1 if last >= 0 else 0
    known = _prefixes(text[:start])
    if known is None:
        start, known = 0, PREFIXES
    prefixes, base = dict(known), ""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text, start) if m.lastgroup]
    blank = _blank(document) if "_:" in text or "[" in text else ""
    tokens += [("end", "")] * 3
    subject = predicate = None
    outer: list[tuple[str | None, str | None]] = []
    made = at = 0

    def term(kind: str, token: str) -> str:
        if kind == "iri":
            return urljoin(base, token[1:-1]) if base else token[1:-1]
        head, colon, tail = token.partition(":")
        if head == "_":
            return f"{blank}:{tail}"
        return prefixes.get(head, head + ":") + tail.replace("\\", "") if colon else token

    while tokens[at][0] != "end":
        kind, token = tokens[at]
        at += 1
        word = token.lstrip("@").lower()
        if subject is None and word in ("prefix", "base") and kind in ("lang", "name"):
            if word == "prefix":
                prefixes[tokens[at][1].removesuffix(":")] = term(*tokens[at + 1])
            else:
                base = term(*tokens[at])
            at = min(at + (2 if word == "prefix" else 1), len(tokens) - 1)
            at += tokens[at] == ("mark", ".")
        elif token == "." and kind == "mark":
            subject = predicate = None
            outer.clear()
        elif token == ";" and kind == "mark":
            predicate = None
        elif token == "[" and kind == "mark":
            made += 1
            node = f"{blank}.{made}"
            if subject is not None and predicate is not None:
                yield subject, predicate, node, False, None
            outer.append((subject, predicate))
            subject, predicate = node, None
        elif token == "]" and kind == "mark":
            node = subject
            subject, predicate = outer.pop() if outer else (None, None)
            subject = node if subject is None else subject
        elif kind in ("iri", "name", "text", "number"):
            literal = kind in ("text", "number") or token in ("true", "false")
            value, lang = (_unquoted(token) if kind == "text" else token) if literal else term(kind, token), None
            if kind == "text" and tokens[at][0] == "lang":
                lang = tokens[at][1][1:]
                at += 1
            elif kind == "text" and tokens[at][0] == "type":
                at = min(at + 2, len(tokens) - 1)
            if subject is None:
                subject = None if literal else value
            elif predicate is None:
                predicate = RDF + "type" if token == "a" else value
            else:
                yield subject, predicate, value, literal, lang


def rdfxml_triples(text: str, document: str) -> Iterator[Triple]:
    if not text.strip():
        return
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(f"RDF/XML of {document}: {e}") from e
    blank, rdf = _blank(document), "{" + RDF + "}"
    name = lambda el: el.tag[1:].replace("}", "", 1) if el.tag.startswith("{") else BASE + el.tag
    made = 0

    def identity(el: ElementTree.Element) -> str:
        nonlocal made
        if rdf + "about" in el.attrib:
            return el.attrib[rdf + "about"]
        if rdf + "ID" in el.attrib:
            return root.attrib.get(XML + "base", "") + "#" + el.attrib[rdf + "ID"]
        if rdf + "nodeID" in el.attrib:
            return f"{blank}:{el.attrib[rdf + 'nodeID']}"
        made += 1
        return f"{blank}.{made}"

    todo = [(el, identity(el), root.attrib.get(XML + "lang")) for el in reversed(root)]
    while todo:
        el, s, lang = todo.pop()
        lang = el.attrib.get(XML + "lang", lang)
        if el.tag != rdf + "Description":
            yield s, RDF + "type", name(el), False, None
        for said in el:
            if rdf + "resource" in said.attrib:
                yield s, name(said), said.attrib[rdf + "resource"], False, None
            elif rdf + "nodeID" in said.attrib:
                yield s, name(said), f"{blank}:{said.attrib[rdf + 'nodeID']}", False, None
            elif len(said):
                for inner in said:
                    o = identity(inner)
                    yield s, name(said), o, False, None
                    todo.append((inner, o, lang))
            elif (said.text or "").strip():
                yield s, name(said), said.text.strip(), True, said.attrib.get(XML + "lang", lang)


def parsed(docs: DataFrame, read: Callable[[str, str], Iterator[Triple]], head: str = "") -> DataFrame:
    """Triples of documents (path, text), each read as if it began with ``head``, which doesn't move with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = chain.from_iterable(read(head + (text or ""), path or "") for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True))
            while part := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return docs.select("path", "text").mapInArrow(run, TRIPLES)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    return parsed(read_text(spark, path), turtle_triples)


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    return parsed(read_text(spark, path), rdfxml_triples)


def turtle_graph(spark: SparkSession, path: str) -> Graph:
    """Nodes, their literal properties and edges of Turtle files."""
    return from_triples(read_turtle(spark, path), properties=True)


def rdfxml_graph(spark: SparkSession, path: str) -> Graph:
    return from_triples(read_rdfxml(spark, path), properties=True)
