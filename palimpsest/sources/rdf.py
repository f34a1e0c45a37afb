"""Facts in Turtle and RDF/XML.  Such a file has to be read as a whole; many are read side by side, each within one task."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .triples import read_triples

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"
SCHEMA = "s string, p string, o string, literal boolean, datatype string"

Fact = tuple[str, str, str, bool, str | None]

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
  | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<type>\^\^)
  | (?P<word>@?[A-Za-z_][\w.-]*(?<!\.):?|(?:[A-Za-z][\w.-]*)?:)
  | (?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?))
  | (?P<mark>[.;,\[\]()])
    """,
    re.X | re.S,
)
_LOCAL = re.compile(r"(?:[\w:-]|\.(?=[\w:-])|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*")
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class _Turtle:
    """A recursive reader of one document."""

    def __init__(self, text: str, document: str):
        self.text, self.at, self.document = text, 0, document
        self.prefixes: dict[str, str] = {}
        self.base, self.blanks = "", 0
        self.out: list[Fact] = []
        self.kind = self.value = None
        self.next()

    def next(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(f"{self.document}: no Turtle at character {self.at}")
            self.at = m.end()
            self.kind, self.value = m.lastgroup, m[0]
            if self.kind == "skip":
                continue
            if self.kind == "word" and self.value.endswith(":") and self.value[0] != "@":
                local = _LOCAL.match(self.text, self.at)
                self.at = local.end()
                self.kind, self.value = "name", (self.value[:-1], re.sub(r"\\(.)", r"\1", local[0]))
            return
        self.kind = self.value = None

    def take(self, mark: str) -> None:
        if self.value != mark:
            raise ValueError(f"{self.document}: {mark} expected before character {self.at}")
        self.next()

    def blank(self) -> str:
        self.blanks += 1
        return f"_:{self.document}--{self.blanks}"

    def resolved(self, iri: str) -> str:
        iri = _unescaped(iri)
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def iri(self) -> str:
        kind, value = self.kind, self.value
        self.next()
        if kind == "iri":
            return self.resolved(value[1:-1])
        if kind == "name":
            prefix, local = value
            return f"_:{self.document}-{local}" if prefix == "_" else self.prefixes[prefix] + local
        raise ValueError(f"{self.document}: a name expected before character {self.at}")

    def document_facts(self) -> list[Fact]:
        while self.kind:
            word = str(self.value).lower()
            if word in ("@prefix", "prefix"):
                self.next()
                prefix = self.value[0]
                self.next()
                self.prefixes[prefix] = self.iri()
            elif word in ("@base", "base"):
                self.next()
                self.base = self.iri()
            else:
                own = self.value == "["
                subject, _, _ = self.object()
                if not (own and self.value == "."):
                    self.predicates(subject)
                self.take(".")
                continue
            if word[0] == "@":
                self.take(".")
        return self.out

    def predicates(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.next()
                predicate = RDF + "type"
            else:
                predicate = self.iri()
            while True:
                self.out.append((subject, predicate, *self.object()))
                if self.value != ",":
                    break
                self.next()
            while self.value == ";":
                self.next()
            if self.value in (".", "]", None):
                return

    def object(self) -> tuple[str, bool, str | None]:
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return self.iri(), False, None
        self.next()
        if value == "[":
            node = self.blank()
            if self.value != "]":
                self.predicates(node)
            self.take("]")
            return node, False, None
        if value == "(":
            items = []
            while self.value != ")":
                items.append(self.object())
            self.next()
            head = RDF + "nil"
            for item in reversed(items):
                node = self.blank()
                self.out += [(node, RDF + "first", *item), (node, RDF + "rest", head, False, None)]
                head = node
            return head, False, None
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            text = _unescaped(value[n:-n])
            if self.kind == "type":
                self.next()
                return text, True, self.iri()
            if self.kind == "word" and self.value[0] == "@":
                self.next()
            return text, True, None
        if kind == "number":
            return value, True, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if value in ("true", "false"):
            return value, True, XSD + "boolean"
        raise ValueError(f"{self.document}: an object expected before character {self.at}")


def parse_turtle(text: str, document: str = "d") -> list[Fact]:
    """(s, p, o, literal, datatype) of a document; blank nodes get its name in front."""
    return _Turtle(text, document).document_facts()


def parse_rdf_xml(text: str, document: str = "d") -> list[Fact]:
    out: list[Fact] = []
    count = 0

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:{document}--{count}"

    def node(e: ET.Element, base: str) -> str:
        base = e.get(f"{XML}base", base)
        get = lambda a: e.get(f"{{{RDF}}}{a}")
        if get("about") is not None:
            subject = full(get("about"), base)
        elif get("ID") is not None:
            subject = f"{base}#{get('ID')}"
        else:
            subject = f"_:{document}-{get('nodeID')}" if get("nodeID") else blank()
        if name(e.tag) != f"{RDF}Description":
            out.append((subject, f"{RDF}type", name(e.tag), False, None))
        for a, v in e.attrib.items():
            if not name(a).startswith(RDF) and not a.startswith(XML):
                out.append((subject, name(a), v, True, None))
        for p in e:
            prop(subject, p, base)
        return subject

    def full(iri: str, base: str) -> str:
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base + iri

    def prop(subject: str, p: ET.Element, base: str) -> None:
        get = lambda a: p.get(f"{{{RDF}}}{a}")
        predicate = name(p.tag)
        if get("resource") is not None:
            out.append((subject, predicate, full(get("resource"), base), False, None))
        elif get("nodeID"):
            out.append((subject, predicate, f"_:{document}-{get('nodeID')}", False, None))
        elif get("parseType") == "Resource":
            inner = blank()
            out.append((subject, predicate, inner, False, None))
            for q in p:
                prop(inner, q, base)
        elif len(p):
            out.append((subject, predicate, node(p[0], base), False, None))
        else:
            out.append((subject, predicate, p.text or "", True, get("datatype")))

    root = ET.fromstring(text)
    for e in root if name(root.tag) == f"{RDF}RDF" else [root]:
        node(e, root.get(f"{XML}base", ""))
    return out


PARSERS = {".ttl": parse_turtle, ".rdf": parse_rdf_xml, ".owl": parse_rdf_xml, ".xml": parse_rdf_xml}


def read_documents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Facts of all files under a path with a suffix (``.ttl``, ``.rdf``, ``.owl``, ``.xml``), or that and ``.gz``.  A file that can't be read is an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{suffix},{suffix}.gz}}").load(path)
    parse = PARSERS[suffix]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                raw = gzip.decompress(content) if file.endswith(".gz") else content
                yield pd.DataFrame(parse(raw.decode("utf-8"), f"{zlib.crc32(file.encode()):08x}"), columns=["s", "p", "o", "literal", "datatype"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_rdf(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Facts (s, p, o, literal, datatype) by the files' suffix: ``.nt``, ``.ttl``, ``.rdf``, ``.owl`` or ``.xml``, gzip or not."""
    if suffix == ".nt":
        return read_triples(spark, path, "*{.nt,.nt.gz}")
    return read_documents(spark, path, suffix)
